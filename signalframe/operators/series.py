"""Sensor series: cleaning, differences, smoothing, normalising, resampling, aligning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.scalars import finite
from signalframe.operators.blocks import exponential_mean, last_so_far, neighbours, numbered, with_halo
from signalframe.operators.filtering import filtered

KEYS = ["source_id", "axis"]


def along(keys: list[str] = KEYS, order: str = "idx"):
    return Window.partitionBy(*keys).orderBy(order)


def clean(signals: DataFrame, keys: list[str] = KEYS, span: float = 3600.0) -> DataFrame:
    """Finite samples, first one of each time, numbered from 0 in slices of `span` of time."""
    rows = signals.where(finite(F.col("t")) & finite(F.col("value")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "t").orderBy("idx"))).where("_n = 1").drop("_n", "idx")
    return numbered(rows, keys, "t", "idx", span)


def relative_time(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    starts = signals.groupBy(*keys).agg(F.min("t").alias("_start"))
    return signals.join(starts, keys).withColumn("t", F.col("t") - F.col("_start")).drop("_start")


def differences(signals: DataFrame, keys: list[str] = KEYS, size: int = 100_000) -> DataFrame:
    rows = neighbours(signals, keys, "idx", {"_t": ("t", -1), "_v": ("value", -1)}, size)
    return rows.withColumns({"dt": F.col("t") - F.col("_t"), "dv": F.col("value") - F.col("_v")}).drop("_t", "_v")


def blocks_of_times(rows: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Rows (keys, t; each time once) with dt, the time since the one before in the series, worked out in slices of `span` of time."""
    sliced = rows.withColumn("_slice", F.floor(F.col("t") / span))
    inside = F.lag("t").over(Window.partitionBy(*keys, "_slice").orderBy("t"))
    ends = sliced.groupBy(*keys, "_slice").agg(F.max("t").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")))
    return sliced.withColumn("_in", inside).join(ends, [*keys, "_slice"]).withColumn("dt", F.col("t") - F.coalesce("_in", "_end")).drop("_in", "_end", "_slice")


def rates(signals: DataFrame) -> DataFrame:
    """Of each series: samples, start, end, and the sampling rate as one over the median positive step."""
    steps = differences(signals).withColumn("dt", F.when(F.col("dt") > 0, F.col("dt")))
    out = steps.groupBy(*KEYS).agg(F.count("*").alias("samples"), F.min("t").alias("start"), F.max("t").alias("end"), F.percentile("dt", F.lit(0.5)).alias("step"))
    return out.withColumn("rate", F.when(F.col("step") > 0, 1 / F.col("step")))


def gradient(signals: DataFrame, out: str = "slope", value: str = "value", keys: list[str] = KEYS, size: int = 100_000) -> DataFrame:
    """Central differences on uneven times, one-sided at the ends; null where times repeat."""
    rows = neighbours(signals, keys, "idx", {"_a": ("t", -1), "_b": ("t", 1), "_low": (value, -1), "_high": (value, 1)}, size)
    h, k, v, low, high = F.col("t") - F.col("_a"), F.col("_b") - F.col("t"), F.col(value), F.col("_low"), F.col("_high")
    ratio = lambda a, b: F.when(b != 0, a / b)
    inner = ratio(h * h * high + (k * k - h * h) * v - k * k * low, h * k * (h + k))
    return rows.withColumn(out, F.when(F.col("_a").isNull(), ratio(high - v, k)).when(F.col("_b").isNull(), ratio(v - low, h)).otherwise(inner)).drop("_a", "_b", "_low", "_high")


def ema(signals: DataFrame, alpha: float, out: str = "ema", keys: list[str] = KEYS, size: int = 100_000) -> DataFrame:
    """Exponential moving average seeded with the first value."""
    return exponential_mean(signals, keys, "idx", "value", alpha, out, size)


def weighted_window(signals: DataFrame, weights: Sequence[float], out: str, keys: list[str] = KEYS, size: int = 100_000) -> DataFrame:
    """Dot product of centred weights with each sample's neighbours; the end values repeat beyond the ends."""
    half = len(weights) // 2
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    ends = signals.groupBy(*keys).agg(F.min_by("value", "idx").alias("_first"), F.max_by("value", "idx").alias("_last"))
    total = F.lit(0.0)
    for i, c in enumerate(weights):
        step = i - half
        total = total + c * (F.coalesce(F.lag("value", -step).over(w), "_first") if step < 0 else F.coalesce(F.lead("value", step).over(w), "_last") if step else F.col("value"))
    rows = with_halo(signals.join(ends, keys), "idx", size, half, half)
    return rows.withColumn(out, total).where(~F.col("halo")).drop("block", "halo", "_first", "_last")


def gaussian(sigma: float, reach: float = 4.0) -> list[float]:
    half = int(reach * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [r / sum(raw) for r in raw]


def zscore(signals: DataFrame, keys: list[str] = KEYS, out: str = "z") -> DataFrame:
    """Standard score with the population deviation; a constant series stays as it is."""
    whole = signals.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return signals.join(whole, keys).withColumn(out, F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.col("value"))).drop("_m", "_s")


def minmax(signals: DataFrame, keys: list[str] = KEYS, out: str = "unit") -> DataFrame:
    whole = signals.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return signals.join(whole, keys).withColumn(out, F.when(F.col("_b") > F.col("_a"), (F.col("value") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.col("value"))).drop("_a", "_b")


def robust(signals: DataFrame, keys: list[str] = KEYS, out: str = "robust") -> DataFrame:
    """Distance from the median in interquartile ranges; a series without a range stays as it is."""
    q = signals.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[2] - F.col("_q")[0]
    return signals.join(q, keys).withColumn(out, F.when(spread > 0, (F.col("value") - F.col("_q")[1]) / spread).otherwise(F.col("value"))).drop("_q")


def trend(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return signals.groupBy(*keys).agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"))


def detrended(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """value without its linear trend, which also centres it; what is left is 0 where it is rounding, at most 1e-12 of the series' largest |value| and |slope * t| together."""
    line = signals.groupBy(*keys).agg(
        F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.max(F.abs("value")).alias("_v"), F.max(F.abs("t")).alias("_t")
    )
    left = F.col("value") - F.col("slope") * F.col("t") - F.col("intercept")
    rounding = F.abs(left) <= 1e-12 * (F.col("_v") + F.abs("slope") * F.col("_t"))
    return signals.join(line, keys).withColumn("value", F.when(rounding, 0.0).otherwise(left)).drop("slope", "intercept", "_v", "_t")


def statistics(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    v = F.col("value")
    out = signals.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"),
    )
    return out.withColumns({"span90": F.col("_q")[1] - F.col("_q")[0], "amplitude": (F.col("_q")[1] - F.col("_q")[0]) / 2}).drop("_q")


def local_maxima(signals: DataFrame, value: str = "value", keys: list[str] = KEYS, order: str = "idx", size: int = 100_000) -> DataFrame:
    """Samples strictly greater than the one before and not less than the one after; `order` is dense."""
    rows = neighbours(signals, keys, order, {"_a": (value, -1), "_b": (value, 1)}, size)
    return rows.where((F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_a", "_b")


def maxima_or_top(signals: DataFrame, value: str = "value", keys: list[str] = KEYS, order: str = "idx", size: int = 100_000) -> DataFrame:
    """The local maxima; of a series that has none (constant, monotonic or under three samples), its first largest sample."""
    rows = neighbours(signals, keys, order, {"_a": (value, -1), "_b": (value, 1)}, size)
    rows = rows.withColumn("_peak", F.coalesce((F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b")), F.lit(False)))
    tops = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max("_peak").alias("_any"), F.max_by(order, F.struct(value, -F.col(order))).alias("_top"))
    return rows.join(tops, keys).where(F.col("_peak") | (~F.col("_any") & (F.col(order) == F.col("_top")))).drop("_a", "_b", "_peak", "_any", "_top")


def resampled(signals: DataFrame, step: float, keys: list[str] = KEYS, size: int = 100_000) -> DataFrame:
    """Linear values at the times k * step, k a whole number, within each series; the last sample's own time is left out.

    Each sample makes the grid points up to the next one, so there is neither a join nor a shuffle beyond the window over blocks. Spark takes the
    grid for as small as the table it came from; the hint keeps it and what follows from it from being broadcast.
    """
    rows = neighbours(signals, keys, "idx", {"_t": ("t", 1), "_v": ("value", 1)}, size).where("_t > t")
    first, last = F.ceil(F.col("t") / step), F.ceil(F.col("_t") / step) - 1
    rows = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("t")) / (F.col("_t") - F.col("t"))
    return rows.select(*keys, "k", (F.col("k") * step).alias("t"), (F.col("value") + share * (F.col("_v") - F.col("value"))).alias("value")).hint("merge")


def common_grid(signals: DataFrame, left: str, right: str, key: str = "source_id") -> DataFrame:
    """Two axes of each source on the grid of their common interval: key, k, t, a, b.

    The grid starts at the later start, ends by the earlier end and has the smaller of the two rates (one over the median
    positive step); sources with fewer than three grid points fall away.
    """
    rows = neighbours(signals.where(F.col("axis").isin(left, right)), [key, "axis"], "idx", {"_t": ("t", 1), "_v": ("value", 1)})
    step = F.col("_t") - F.col("t")
    sides = rows.groupBy(key, "axis").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.percentile(F.when(step > 0, step), F.lit(0.5)).alias("step"))
    both = sides.groupBy(key).agg(F.max("start").alias("_start"), F.min("end").alias("_end"), (1 / F.max("step")).alias("_rate"), F.count("step").alias("_sides"))
    both = both.withColumn("_top", F.floor((F.col("_end") - F.col("_start")) * F.col("_rate"))).where("_sides = 2 and _top >= 2")
    place = lambda t: (F.col(t) - F.col("_start")) * F.col("_rate")
    last = F.when(F.col("_t") >= F.col("_end"), F.floor(place("_t"))).otherwise(F.ceil(place("_t")) - 1)
    rows = rows.where("_t > t").join(both, key).withColumns({"_a": F.greatest(F.ceil(place("t")), F.lit(0)), "_b": F.least(last, F.col("_top"))})
    rows = rows.where("_a <= _b and t < _end").withColumn("k", F.explode(F.sequence("_a", "_b"))).withColumn("at", F.col("_start") + F.col("k") / F.col("_rate"))
    value = F.col("value") + (F.col("at") - F.col("t")) / (F.col("_t") - F.col("t")) * (F.col("_v") - F.col("value"))
    pick = lambda axis: F.max(F.when(F.col("axis") == axis, value))
    return rows.groupBy(key, "k").agg(F.max("at").alias("t"), pick(left).alias("a"), pick(right).alias("b")).where("a is not null and b is not null")


def paired(grid: DataFrame, left: str, right: str, key: str = "source_id") -> DataFrame:
    """Two axes of each source on their common grid: k, a, b."""
    a = grid.where(F.col("axis") == left).select(key, "k", F.col("value").alias("a"))
    b = grid.where(F.col("axis") == right).select(key, "k", F.col("value").alias("b"))
    return a.join(b, [key, "k"])


def axis_pairs(grid: DataFrame, key: str = "source_id") -> DataFrame:
    """All pairs of two axes of each source on their common grid: left, right (by name), k, a, b."""
    a = grid.select(key, "k", F.col("axis").alias("left"), F.col("value").alias("a"))
    b = grid.select(key, "k", F.col("axis").alias("right"), F.col("value").alias("b"))
    return a.join(b, [key, "k"]).where(F.col("left") < F.col("right"))


def normalised_envelope(grid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Values (k, value; k dense) divided by the median of the first 5 % of their series, of three at least; where that is none, by the largest."""
    whole = grid.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("k").alias("_k"), F.max(F.abs("value")).alias("_top"))
    rows = grid.join(whole, keys)
    first = rows.where(F.col("k") - F.col("_k") + 1 <= F.greatest(F.lit(3.0), F.bround(0.05 * F.col("_n"), 0)))
    scale = first.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("_s"))
    eps = 2.220446049250313e-16
    by = F.when(F.col("_s") > eps, F.col("_s")).when(F.col("_top") > eps, F.col("_top"))
    return rows.join(scale, keys).withColumn("value", F.col("value") / by).drop("_k", "_n", "_s", "_top")


def pair_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of b against a: Pearson (null when flat), RMSE, by range, MAE, largest, median, bias, R squared."""
    e, a = F.col("b") - F.col("a"), F.col("a")
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when((F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), F.corr("a", "b")).alias("pearson"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_error"), F.percentile(F.abs(e), F.lit(0.5)).alias("med_error"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("residual_std"),
        (F.max(a) - F.min(a)).alias("_range"), F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count("*")).alias("_sst"),
    )
    return out.withColumns({"nrmse": F.when(F.col("_range") > 0, F.col("rmse") / F.col("_range")), "r2": F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))}).drop("_range", "_sse", "_sst")


def lag_products(pairs: DataFrame, keys: list[str], max_lag: int, size: int = 8192) -> DataFrame:
    """Normalised cross correlation of a and b (centred) at lags -max_lag .. max_lag of b behind a.

    Blocks of `size` indices, with b of max_lag more on both sides, give partial sums of all lags; these are summed up by lag.
    """
    means = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in "ab"])
    rows = pairs.join(means, keys).select(*keys, "k", *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in "ab"])
    norm = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))).alias("_norm"))
    size = max(size, 2 * max_lag)
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        block = key[-1].as_py()
        at = part.column("k").to_numpy() - block * size
        own = (at >= 0) & (at < size)
        a, b = (part.column(c).fill_null(0.0).to_numpy() for c in "ab")
        left = [np.bincount(at[own], w, size) for w in (a[own], None)]
        right = [np.bincount(at + max_lag, w, size + 2 * max_lag) for w in (b, None)]
        found = [(lag, int(round(n)), ab) for lag in range(-max_lag, max_lag + 1) for ab, n in [tuple(float(x @ y[max_lag + lag :][:size]) for x, y in zip(left, right, strict=True))] if n]
        columns = {name: pa.repeat(value, len(found)) for name, value in zip(keys, key[:-1], strict=True)}
        return pa.table(columns | {c: pa.array([x[i] for x in found], kind) for i, (c, kind) in enumerate((("lag", pa.int32()), ("n", pa.int64()), ("ab", pa.float64())))})

    blocks = F.sequence(F.floor((F.col("k") - max_lag) / size), F.floor((F.col("k") + max_lag) / size))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "lag int, n long, ab double"])
    parts = rows.withColumn("_block", F.explode(blocks)).groupBy(*keys, "_block").applyInArrow(run, schema)
    sums = parts.groupBy(*keys, "lag").agg(F.sum("ab").alias("_ab"), F.sum("n").alias("n"))
    return sums.join(norm, keys).select(*keys, "lag", "n", F.when(F.col("_norm") > 0, F.col("_ab") / F.col("_norm")).alias("r"))


def best_lag(products: DataFrame, keys: list[str], signed: bool) -> DataFrame:
    """Lag of the largest correlation (signed or absolute), ties to the smaller lag."""
    score = F.round(F.col("r") if signed else F.abs("r"), 9)
    return products.where("r is not null").groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct(score, -F.col("lag"))).alias("_b")).select(*keys, "_b.*")


def aligned(pairs: DataFrame, lags: DataFrame, keys: list[str]) -> DataFrame:
    """a and b with b taken `lag` steps later: the head of b and the tail of a, or the reverse, fall away."""
    a = pairs.select(*keys, "k", "a").join(lags.select(*keys, "lag"), keys).withColumn("_k", F.col("k") + F.col("lag"))
    b = pairs.select(*keys, F.col("k").alias("_k"), "b")
    return a.join(b, [*keys, "_k"]).select(*keys, "k", "lag", "a", "b")


def decimated(signals: DataFrame, every: int) -> DataFrame:
    return signals.where(F.col("idx") % every == 0)


def hold_last(df: DataFrame, keys: list[str], order: str, ok: Column, columns: list[str], size: int = 100_000) -> DataFrame:
    """The last values that were ok, up to each row."""
    return last_so_far(df, keys, order, {f"held_{c}": F.when(ok, F.col(c)) for c in columns}, size)


def decay_start(envelopes: DataFrame, fraction: float, keys: list[str] = KEYS) -> DataFrame:
    """After the largest value, the first time at which the value is at most `fraction` of it."""
    top = envelopes.groupBy(*keys).agg(F.max("value").alias("top"), F.min_by("t", F.struct(-F.col("value"), F.col("t"))).alias("top_t"))
    later = envelopes.join(top, keys).where((F.col("t") >= F.col("top_t")) & (F.col("value") <= fraction * F.col("top")))
    return top.join(later.groupBy(*keys).agg(F.min("t").alias("start_t")), keys, "left")


def decay_fit(envelopes: DataFrame, keys: list[str] = KEYS, low: float = 0.08, high: float = 0.98) -> DataFrame:
    """Exponential decay by a line through the logarithms of values within [low, high] of the largest: rate, time constant, R squared."""
    rows = envelopes.join(envelopes.groupBy(*keys).agg(F.max("value").alias("_top")), keys).where((F.col("value") > 0) & F.col("value").between(low * F.col("_top"), high * F.col("_top")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.ln("value"), F.col("t")).alias("slope"), F.regr_r2(F.ln("value"), F.col("t")).alias("r2"))
    return out.withColumn("tau", F.when(F.col("slope") < 0, -1 / F.col("slope")))


def free_decay_start(envelopes: DataFrame, fraction: float, least: float, keys: list[str] = KEYS) -> DataFrame:
    """decay_start, or the time of the largest value where none is as low, and early enough that `least` of time remains.

    Series of fewer than 8 samples start at their first time.
    """
    eps = 2.220446049250313e-16
    ends = envelopes.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("t").alias("_first"), F.max("t").alias("_last"), F.max("value").alias("_high"), F.min_by("t", F.struct(-F.col("value"), F.col("t"))).alias("_top_t"))
    low = F.when((F.col("t") >= F.col("_top_t")) & (F.col("value") <= F.greatest(fraction * F.col("_high"), F.lit(eps))), F.col("t"))
    first = envelopes.join(ends, keys).groupBy(*keys).agg(F.min(low).alias("_low"), *[F.first(c).alias(c) for c in ("_n", "_first", "_last", "_top_t")])
    capped = F.least(F.coalesce("_low", "_top_t"), F.col("_last") - least)
    return first.select(*keys, F.when(F.col("_n") < 8, F.col("_first")).otherwise(capped).alias("start_t"))


def free_decay_fit(envelopes: DataFrame, keys: list[str] = KEYS, low: float = 0.08, high: float = 0.98, least: int = 8) -> DataFrame:
    """decay_fit where at least `least` values lie within [low, high] of the largest, else over all positive values; null where these are fewer."""
    eps = 2.220446049250313e-16
    rows = envelopes.where("value > 0 AND t IS NOT NULL")
    rows = rows.join(rows.groupBy(*keys).agg(F.greatest(low * F.max("value"), F.lit(eps)).alias("_low"), (high * F.max("value")).alias("_high")), keys)
    inside = F.col("value").between(F.col("_low"), F.greatest("_high", "_low"))
    log, t = F.ln("value"), F.col("t")
    near = F.when(inside, log)
    out = rows.groupBy(*keys).agg(
        F.count(near).alias("_in"), F.count("*").alias("_all"), F.regr_slope(near, t).alias("_slope"), F.regr_r2(near, t).alias("_r2"),
        F.regr_slope(log, t).alias("_slope_all"), F.regr_r2(log, t).alias("_r2_all"),
    )
    pick = lambda a, b: F.when(F.col("_in") >= least, F.col(a)).when(F.col("_all") >= least, F.col(b))
    out = out.select(*keys, pick("_in", "_all").alias("n"), pick("_slope", "_slope_all").alias("slope"), pick("_r2", "_r2_all").alias("r2"))
    return out.withColumn("tau", F.when(F.col("slope") < -eps, -1 / F.col("slope")))


def standardised_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of a and b: their root mean squares, and of their standardised forms the correlation, its size, RMSE and MAE; null where one is flat."""
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"_{f.__name__}_{c}") for c in "ab" for f in (F.avg, F.stddev_pop)], *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in "ab"])
    z = {c: F.when(F.col(f"_stddev_pop_{c}") > 0, (F.col(c) - F.col(f"_avg_{c}")) / F.col(f"_stddev_pop_{c}")) for c in "ab"}
    rows = pairs.join(means, keys).select(*keys, "n", "rms_a", "rms_b", z["a"].alias("a"), z["b"].alias("b"))
    e = F.col("b") - F.col("a")
    out = rows.groupBy(*keys, "n", "rms_a", "rms_b").agg(F.avg(F.col("a") * F.col("b")).alias("pearson"), F.sqrt(F.avg(e * e)).alias("rmse_z"), F.avg(F.abs(e)).alias("mae_z"))
    return out.withColumn("abs_pearson", F.abs("pearson"))


def band_limited_metrics(pairs: DataFrame, keys: list[str], order: int, low: float, high: float, max_lag: int, trim: int) -> DataFrame:
    """Of a and b (k dense) after the same zero-phase band-pass (cutoffs in cycles per step): the lag of the largest absolute correlation within max_lag, and on the
    samples aligned by it the number, the band's root mean squares and the standardised metrics.

    `trim` samples at both ends of each series, where the filter still swings in, are left out before the lag is looked for.
    """
    ends = pairs.groupBy(*keys).agg(F.min("k").alias("_a"), F.max("k").alias("_b"))
    rows = pairs.join(ends, keys).select(*keys, (F.col("k") - F.col("_a")).cast("long").alias("k"), (F.col("_b") - F.col("_a")).alias("_top"), *[F.col(c).cast("double").alias(c) for c in "ab"])
    rows = filtered(filtered(rows, keys, "k", "a", order, low, high, "_fa"), keys, "k", "b", order, low, high, "_fb")
    rows = rows.where((F.col("k") >= trim) & (F.col("k") <= F.col("_top") - trim)).select(*keys, "k", F.col("_fa").alias("a"), F.col("_fb").alias("b"))
    lags = best_lag(lag_products(rows, keys, max_lag), keys, signed=False)
    found = standardised_metrics(aligned(rows, lags, keys), keys)
    return found.join(lags.select(*keys, "lag", F.col("r").alias("peak")), keys)
