"""The registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalframe.plans import alignment_queries, archive_queries, evaluation_queries, point_queries, recording_queries, series_queries, spectral_queries, stage_queries, study_queries, summary_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = {**point_queries.QUERIES, **series_queries.QUERIES, **archive_queries.QUERIES, **spectral_queries.QUERIES, **study_queries.QUERIES, **evaluation_queries.QUERIES, **recording_queries.QUERIES, **alignment_queries.QUERIES, **summary_queries.QUERIES, **stage_queries.QUERIES}


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {name: sql for name, (_, sql) in ALL.items() if sql}
