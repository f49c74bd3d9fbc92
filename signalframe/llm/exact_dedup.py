"""Exact deduplication with a split for heavy hitters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import fresh, materialize


def frequent(digests: DataFrame, digest: str, capacity: int, rows: int) -> DataFrame:
    """Candidates (digest, seen): each value that more than 2 / (capacity + 1) of all `rows` rows have is among them.

    Every partition keeps a Misra-Gries summary of at most `capacity` counters. A counter is too low by at most
    1 / (capacity + 1) of its partition's rows, so sums over that share of all rows are at most `capacity` many.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                kept[pair["values"]] = kept.get(pair["values"], 0) + pair["counts"]
            if len(kept) > capacity:
                least = sorted(kept.values(), reverse=True)[capacity]
                kept = {k: n - least for k, n in kept.items() if n > least}
        yield pa.RecordBatch.from_pydict({digest: pa.array(list(kept), pa.string()), "seen": pa.array(list(kept.values()), pa.int64())})

    summaries = digests.select(digest).mapInArrow(summarise, f"{digest} string, seen long")
    return summaries.groupBy(digest).agg(F.sum("seen").alias("seen")).where(F.col("seen") * (capacity + 1) > rows)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 255) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 digests are; a null text counts as empty. Of equal texts the largest id stays.
    Frequent digests come from Misra-Gries summaries; a count of all rows verifies them, and the verified ones
    (at most `capacity` rows) are broadcast, so their rows never move. Any other digest has at most
    2 / (capacity + 1) of the rows; counts of these are combined before they are shuffled, and the join that brings them
    back splits what is skewed.

    Repeated rows of one id and text are one document: each is returned and each is kept or not kept alike. A null
    id never beats another id; where all ids of a text are null, all its rows are kept. Empty input gives no rows.
    Other columns are not looked at, whatever their names.
    """
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")))
    rows = digests.count()
    candidates = frequent(digests, "text_sha256", capacity, rows)
    exact = digests.join(F.broadcast(candidates.select("text_sha256")), "text_sha256").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = materialize(exact.where(F.col("group_size") * (capacity + 1) > 2 * rows))
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.join(rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return heavy.select(*columns).union(rest.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever other texts their ids have."""
    gone, of = fresh(docs, "gone"), fresh(docs, "of")
    dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(of)).distinct()
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.join(dropped, F.col(id_col).eqNullSafe(F.col(gone)) & (digest == F.col(of)), "left_anti")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
