"""Scores of recordings and candidates, and the orders in which results are ranked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.scalars import relative_difference


def quality_score(duration: Column, rate: Column, upper: float, prominence: Column) -> Column:
    """0 to 100 from fixed shares: 0.35 duration up to 20 s, 0.25 sampling rate up to 2.5 times the upper frequency, 0.40 log10 of the prominence up to 1000."""
    one = F.lit(1.0)
    parts = 0.35 * F.least(one, duration / 20.0) + 0.25 * F.least(one, rate / max(2.5 * upper, 1.0)) + 0.40 * F.least(one, F.log10(F.greatest(prominence, one)) / 3.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * parts))


#: Fixed values of pair_similarity: column -> (weight, decay, floor of the relative difference).
SIMILARITY = {"frequency": (0.55, 4.0, 0.1), "centroid": (0.15, 2.0, 0.1), "bandwidth": (0.10, 1.5, 0.1), "duration": (0.10, 1.5, 1.0)}


def pair_similarity(left: str = "left_", right: str = "right_") -> Column:
    """0 to 100: weight * exp(-decay * relative difference) of each column, and 0.10 of the lower quality."""
    total = 0.10 * F.least(F.col(f"{left}quality"), F.col(f"{right}quality")) / 100.0
    for c, (weight, decay, floor) in SIMILARITY.items():
        total = total + weight * F.exp(-decay * relative_difference(F.col(left + c), F.col(right + c), floor))
    return 100.0 * total


def ranked_partners(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, tiles: int = 64) -> DataFrame:
    """The k most similar rows (right_id) of each query (left_id), with score as by pair_similarity and rank, ties by right_id; every query meets every row.

    Queries are dealt to blocks of about `block` and rows to `tiles`. Each block meets each tile in one task, which gives the k best rows of its queries only,
    so what is shuffled is both sides and these, not the pairs. A null score comes last.
    """
    blocks = max(1, -(-queries.count() // block))
    columns = ["quality", *SIMILARITY]
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    side = lambda df, s: df.where(F.col(f"{s}_id").isNotNull()).select(f"{s}_id", *[F.col(f"{s}_{c}").cast("double").alias(f"{s}_{c}") for c in columns])
    left = side(queries, "left").withColumns({"_block": deal("left_id", blocks), "_tile": F.explode(number(tiles))})
    right = side(rows, "right").withColumns({"_tile": deal("right_id", tiles), "_block": F.explode(number(blocks))})
    schema = f"left_id {dict(queries.dtypes)['left_id']}, right_id {dict(rows.dtypes)['right_id']}, score double"

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("right_id")
        values = {f"{s}_{c}": t.column(f"{s}_{c}").to_numpy() for s, t in (("left", a), ("right", b)) for c in columns}  # null is NaN
        same = pa.chunked_array([*b.column("right_id").chunks, *a.column("left_id").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        found = []
        for at in range(0, len(a), chunk := max(1, 250_000 // max(1, len(b)))):
            x = {c: values[f"left_{c}"][at : at + chunk, None] for c in columns}
            score = 0.10 * np.fmin(x["quality"], values["right_quality"]) / 100.0
            for c, (weight, decay, floor) in SIMILARITY.items():
                y = values[f"right_{c}"]
                score = score + weight * np.exp(-decay * (abs(x[c] - y) / np.maximum(np.maximum(abs(x[c]), abs(y)), floor)))
            score *= 100.0
            order = np.where(np.isnan(score), -1.0, np.round(score, 9))  # scores are 0 at least
            order[same[len(b) + at : len(b) + at + chunk, None] == same[: len(b)]] = -2.0
            for _ in range(min(k, len(b))):
                top = order.argmax(1)  # the first of equal ones
                own = np.flatnonzero(order[np.arange(len(order)), top] > -2.0)
                found.append((own + at, top[own], score[own, top[own]]))
                order[np.arange(len(order)), top] = -2.0
        one, other, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], np.empty(0))
        return pa.table({"left_id": a.column("left_id").take(pa.array(one, pa.int64())), "right_id": b.column("right_id").take(pa.array(other, pa.int64())), "score": pa.array(score, pa.float64(), mask=np.isnan(score))})

    # a number of partitions that is asked for is not coalesced by their few bytes, which say nothing of the pairs
    left, right = (df.repartition(min(4096, blocks * tiles), "_block", "_tile") for df in (left, right))
    pairs = left.groupBy("_block", "_tile").cogroup(right.groupBy("_block", "_tile")).applyInArrow(best, schema)
    order = Window.partitionBy("left_id").orderBy(F.desc(F.round("score", 9)), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def combined_scores(candidates: DataFrame, video_duration: float, threshold: float, time_weight: float, frequency_weight: float) -> DataFrame:
    """time_score, frequency_score and their weighted sum (less is better) from overlap, gap and peak_error."""
    total = time_weight + frequency_weight
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    time = F.when(F.coalesce("overlap", F.lit(0.0)) > 0, 0.0).otherwise(F.col("gap") / max(video_duration, 1.0))
    rows = candidates.withColumns({"time_score": time, "frequency_score": F.col("peak_error") / max(threshold, 1e-12)})
    return rows.withColumn("combined", time_weight / total * F.col("time_score") + frequency_weight / total * F.col("frequency_score"))


def candidate_lists(candidates: DataFrame, margin: float, threshold: float, top_n: int, ties: list[str]) -> DataFrame:
    """The lists temporal, dominant_frequency, any_peak (top_n rows each, with rank) and simultaneous (all rows, no rank).

    candidates: overlap, gap, frequency_error, peak_error, peak_rank and the columns of ties, which settle equal rows.
    """
    near = (F.col("overlap") > 0) | (F.col("gap") <= margin)
    alike = F.col("peak_error") <= threshold
    by_time = [F.desc("overlap"), F.asc("gap"), F.asc("peak_error")]
    lists = {
        "temporal": (near, by_time),
        "dominant_frequency": (F.col("frequency_error") <= threshold, [F.asc("frequency_error"), F.asc("gap")]),
        "any_peak": (alike, [F.asc("peak_error"), F.asc("peak_rank"), F.asc("gap")]),
    }
    out = candidates.where(near & alike).withColumns({"list": F.lit("simultaneous"), "rank": F.lit(None).cast("int")})
    for name, (test, order) in lists.items():
        best = candidates.where(test).orderBy(*order, *ties).limit(top_n)
        w = Window.partitionBy("list").orderBy(*order, *ties)
        out = out.unionByName(best.withColumn("list", F.lit(name)).withColumn("rank", F.row_number().over(w)))
    return out


#: How each mode ranks: column expression, and whether more is better.
MODES = {"final_rank": ("final_rank", False), "pearson": ("pearson", True), "absolute_pearson": ("abs(pearson)", True), "rmse": ("rmse", False)}


def best_candidate(results: DataFrame, mode: str, keys: list[str], tie: str) -> DataFrame:
    """Of each key the successful row that the mode puts first; rows without its value do not count, ties go to the least `tie`."""
    metric, more = MODES[mode]
    rows = results.where("lower(status) = 'success'").withColumn("_m", F.round(F.expr(metric).cast("double"), 9)).where("_m is not null")
    order = F.struct(-F.col("_m") if more else F.col("_m"), tie)
    columns = [c for c in results.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_b")).select(*keys, "_b.*")


def ranked_results(results: DataFrame, keys: list[str], metrics: list[tuple[str, bool]], ties: list[str]) -> DataFrame:
    """Results with rank within each key: successes first, by the metrics (column, more is better), nulls last, then by ties."""
    order = [F.desc(F.coalesce(F.lower("status") == "success", F.lit(False)))]
    for metric, more in metrics:
        value = F.round(F.expr(metric), 9)
        order.append(value.desc_nulls_last() if more else value.asc_nulls_last())
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties)))


def candidates_of(candidates: DataFrame, video_id: str, k: int) -> DataFrame:
    """The first k candidates of a video, by rank, then the larger score, then the source row; ids are compared without case and blanks."""
    rows = candidates.where(F.lower(F.trim("video_id")) == video_id.strip().lower())
    return rows.orderBy("rank_for_video", F.col("score").desc_nulls_last(), "source_row").limit(k)


def flag_best(rows: DataFrame, error: str, keys: list[str], tie: str, limit: float) -> DataFrame:
    """rows with best, whether a row has the smallest error of its keys (ties to the smaller `tie`, none where all errors are null), and passed, whether its error is within limit."""
    tops = rows.where(F.col(error).isNotNull()).groupBy(*keys).agg(F.min_by(tie, F.struct(F.round(error, 9), tie)).alias("_best"))
    flags = {"best": F.coalesce(F.col(tie) == F.col("_best"), F.lit(False)), "passed": F.coalesce(F.col(error) <= limit, F.lit(False))}
    return rows.join(tops, keys, "left").withColumns(flags).drop("_best")
