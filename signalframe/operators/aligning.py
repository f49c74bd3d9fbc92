"""As-of values of irregular series at any times, and pairs of series brought together by a lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.operators.blocks import neighbours
from signalframe.operators.series import best_lag, lag_products


def as_of(targets: DataFrame, series: DataFrame, keys: list[str], span: float, t: str = "t", value: str = "value", out: str = "value") -> DataFrame:
    """Rows of targets (keys, t, others) with the linear value of the series of the same keys at t; null before its first and after its last sample.

    Both sides are merged by time within slices of `span`; a slice knows the last sample of the slices before it and the first of those
    after it from one small row a slice, so no task needs a whole series, however far apart its samples are. The times of
    a series differ (series.clean). Targets of keys without a series get null; rows without a time too.
    """
    others = [c for c in targets.columns if c not in (*keys, t)]
    sample = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    left = targets.select(*keys, F.col(t).cast("double").alias("_t"), F.struct(F.lit(1).alias("_one"), *others).alias("_row"), F.lit(None).cast("struct<t:double,v:double>").alias("_s"))
    right = series.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), sample.cast("struct<t:double,v:double>").alias("_s"))
    both = left.unionByName(right).withColumn("_slice", F.floor(F.col("_t") / span))
    ends = both.groupBy(*keys, "_slice").agg(F.max("_s").alias("_last"), F.min("_s").alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_of"), F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t")
    rows = both.withColumns({"_p": F.last("_s", True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.first("_s", True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    on = F.col("_slice").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.where("_row is not null").join(ends, on).withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")})
    share = (F.col("_t") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    found = F.when(F.col("_p.t") == F.col("_t"), F.col("_p.v")).when(F.col("_n.t") > F.col("_p.t"), F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v")))
    return rows.select(*keys, F.col("_t").alias(t), *[F.col(f"_row.{c}").alias(c) for c in others], found.alias(out))


def lag_seconds(pairs: DataFrame, keys: list[str], step: float, mode: str = "correlation", max_lag: int | None = None, manual: float | None = None) -> DataFrame:
    """keys and lag_s, how far b of the pairs (k, a, b on a grid of `step`) is behind a.

    Modes: "correlation" (largest absolute correlation within max_lag steps), "manual" (the given seconds), "none" and "timestamp" (0).
    """
    if mode == "correlation":
        lags = best_lag(lag_products(pairs, keys, max_lag), keys, signed=False)
        return lags.select(*keys, (F.col("lag") * step).alias("lag_s"))
    if mode not in ("manual", "none", "timestamp") or (mode == "manual") != (manual is not None):
        raise ValueError(f"mode {mode!r} with manual lag {manual}")
    return pairs.select(*keys).distinct().withColumn("lag_s", F.lit(float(manual or 0.0)))


def synchronised(reference: DataFrame, moving: DataFrame, lags: DataFrame, keys: list[str], rate: float, span: float) -> DataFrame:
    """Both series (keys, t, value) at common times, with the times of `moving` corrected by -lag_s: keys, k, t (from 0), lag_s, a, b.

    The times run from the later start to the earlier end at `rate`. Keys that one of the three tables lacks, or whose lag leaves no overlap, fall away.
    """
    late = moving.join(lags, keys).withColumn("t", F.col("t") - F.col("lag_s"))

    def ends(rows: DataFrame, name: str, *more: Column) -> DataFrame:
        return rows.where("t is not null and value is not null").groupBy(*keys).agg(F.min("t").alias(f"_s{name}"), F.max("t").alias(f"_e{name}"), *more)

    both = ends(reference, "a").join(ends(late, "b", F.first("lag_s").alias("lag_s")), keys).select(*keys, "lag_s", F.greatest("_sa", "_sb").alias("_start"), F.least("_ea", "_eb").alias("_end")).where("_end > _start")
    last = F.floor((F.col("_end") - F.col("_start")) * rate)
    grid = both.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(10_000).cast("long")))).withColumn("k", F.explode(F.sequence("_b", F.least(F.col("_b") + 9999, last))))
    grid = grid.select(*keys, "k", "lag_s", "_start", (F.col("_start") + F.col("k") / rate).alias("t"))
    found = as_of(as_of(grid, reference, keys, span, out="a"), late, keys, span, out="b")
    return found.select(*keys, "k", (F.col("t") - F.col("_start")).alias("t"), "lag_s", "a", "b")


def common_points(a: DataFrame, b: DataFrame, keys: list[str], span: float, least: int = 50) -> DataFrame:
    """Both series (keys, t, value) at evenly spaced times from the later start to the earlier end: keys, k, t, n (of these times), a, b.

    There are as many times as the shorter series has samples, `least` at least, both ends among them. Keys that one series lacks or whose series
    do not overlap fall away. Times of a series differ.
    """
    ends = lambda rows, n: rows.where("t is not null and value is not null").groupBy(*keys).agg(F.min("t").alias(f"_s{n}"), F.max("t").alias(f"_e{n}"), F.count("*").alias(f"_n{n}"))
    both = ends(a, "a").join(ends(b, "b"), keys).select(*keys, F.greatest("_sa", "_sb").alias("_start"), F.least("_ea", "_eb").alias("_end"), (F.greatest(F.lit(least), F.least("_na", "_nb")) - 1).cast("long").alias("_last")).where("_end > _start")
    grid = both.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(10_000).cast("long")))).withColumn("k", F.explode(F.sequence("_b", F.least(F.col("_b") + 9999, "_last"))))
    t = F.when(F.col("k") == F.col("_last"), F.col("_end")).otherwise(F.least("_end", F.col("_start") + F.col("k") * ((F.col("_end") - F.col("_start")) / F.col("_last"))))
    sides = grid.select(*keys, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("_side"), "k", (F.col("_last") + 1).alias("n"), t.alias("t"))
    samples = a.select(*keys, F.lit("a").alias("_side"), "t", "value").unionByName(b.select(*keys, F.lit("b").alias("_side"), "t", "value"))
    found = as_of(sides, samples, [*keys, "_side"], span)
    return found.groupBy(*keys, "k").agg(F.max("t").alias("t"), F.max("n").alias("n"), *[F.max(F.when(F.col("_side") == c, F.col("value"))).alias(c) for c in "ab"])


def envelope_agreement(a: DataFrame, b: DataFrame, keys: list[str], span: float, least: int = 50, size: int = 100_000) -> DataFrame:
    """Of each pair of envelopes on their common points, each divided by its start: n, correlation, rmse, mae and residual_lag1.

    The correlations are null where a side is flat, that of the residual with itself one point later also under four points.
    """
    flat = 2.220446049250313e-16
    points = common_points(a, b, keys, span, least)
    first = F.col("k") < F.greatest(F.lit(3.0), F.bround(0.05 * F.col("n"), 0))
    scales = points.groupBy(*keys).agg(*[f.alias(f"_{n}{c}") for c in "ab" for n, f in (("s", F.percentile(F.when(first, F.col(c)), F.lit(0.5))), ("t", F.max(F.abs(c))))])
    by = lambda c: F.when(F.col(f"_s{c}") > flat, F.col(f"_s{c}")).when(F.col(f"_t{c}") > flat, F.col(f"_t{c}"))
    wide = points.join(scales, keys).select(*keys, "k", *[(F.col(c) / by(c)).alias(c) for c in "ab"])
    rows = neighbours(wide.withColumn("_e", F.col("a") - F.col("b")), keys, "k", {"_next": ("_e", 1)}, size)

    def correlation(x: Column, y: Column) -> Column:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        deviations = F.stddev_pop(x), F.stddev_pop(y)
        return F.when((F.count(x) >= 3) & (deviations[0] > flat) & (deviations[1] > flat), F.covar_pop(x, y) / (deviations[0] * deviations[1]))

    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), correlation(F.col("a"), F.col("b")).alias("correlation"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), correlation(F.col("_e"), F.col("_next")).alias("residual_lag1")
    )
