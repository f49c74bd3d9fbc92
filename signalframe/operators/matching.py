"""Matching recordings against an archive: inventories, interval joins, pair rankings, candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.scalars import match_score, relative_error
from signalframe.operators.series import maxima_or_top


def inventory(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Of each recording: rows, start, end, duration, rate and value statistics."""
    w = Window.partitionBy(*keys).orderBy("t", "idx")
    step = F.when(F.col("_d") > 0, F.col("_d"))
    v = F.col("value")
    out = signals.withColumn("_d", F.col("t") - F.lag("t").over(w)).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("t").alias("start"), F.max("t").alias("end"), F.percentile(step, F.lit(0.5)).alias("_step"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) - F.min(v)).alias("peak_to_peak")
    )
    return out.withColumns({"duration": F.col("end") - F.col("start"), "rate": F.when(F.col("_step") > 0, 1 / F.col("_step"))}).drop("_step")


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def gap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), other_start - end, start - other_end)


def interval_join(measurements: DataFrame, windows: DataFrame, margin: float, bin_width: float) -> DataFrame:
    """Pairs whose intervals overlap or lie at most `margin` apart, with overlap and gap.

    Both sides are dealt to time bins, the windows widened by the margin; the exact test follows and each pair is
    kept in its first common bin only. So the join is an equi-join on the bin, whichever side is large.
    """
    low = lambda c: F.floor(c / bin_width)
    left = measurements.withColumn("_bin", F.explode(F.sequence(low(F.col("start")), low(F.col("end")))))
    right = windows.withColumn("_bin", F.explode(F.sequence(low(F.col("window_start") - margin), low(F.col("window_end") + margin))))
    pairs = left.join(right, "_bin")
    ends = [F.col(c) for c in ("start", "end", "window_start", "window_end")]
    first = F.greatest(low(F.col("start")), low(F.col("window_start") - margin))
    pairs = pairs.where((F.col("_bin") == first) & (gap(*ends) <= margin)).drop("_bin")
    return pairs.withColumns({"overlap": overlap(*ends), "gap": gap(*ends)})


def peak_lists(spectra: DataFrame, reference: float, n: int, low: float, high: float, keys: list[str]) -> DataFrame:
    """Of each series its n strongest local peaks with low <= frequency <= high and above 0: keys, peaks (array of rank, frequency, amplitude, strength, error).

    Strength is the amplitude in percent of the first peak's, error that of the frequency against the reference in percent. Where no bin stands out
    the largest is the peak; equal amplitudes go by frequency.
    """
    inside = spectra.where(F.col("frequency").between(low, high) & (F.col("frequency") > 0))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("amplitude", 9)), "bin")
    rows = maxima_or_top(inside, "amplitude", keys, "bin").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    fields = F.struct("rank", "frequency", "amplitude", relative_error(F.col("frequency"), F.lit(reference)).alias("error"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_p"))
    top = F.col("_p")[0]["amplitude"]
    full = F.transform("_p", lambda p: F.struct(p["rank"].alias("rank"), p["frequency"].alias("frequency"), p["amplitude"].alias("amplitude"), F.when(top > 0, 100.0 * p["amplitude"] / top).alias("strength"), p["error"].alias("error")))
    return lists.select(*keys, full.alias("peaks"))


def measurements(signals: DataFrame, peaks: DataFrame, video: tuple[float, float], key: str = "source_id", axis: str = "axis") -> DataFrame:
    """One row per recording: its extent against the video's interval, nested values of each axis, and the best axis and peak.

    key, rows, start, end, duration, overlap, overlap_percent, gap, start_difference, end_difference; axes, an array by axis name of (axis, status, n, mean,
    std, rms, low, high, span90, peaks); best_axis, best_frequency and best_error by the error of the axes' strongest peaks; any_axis, any_rank,
    any_frequency, any_strength and any_error by that of all peaks. Equal errors go by axis, then rank. One grouping by axis and one by recording.
    """
    v, start, end = F.col("value"), F.lit(float(video[0])), F.lit(float(video[1]))
    by_axis = signals.groupBy(key, axis).agg(
        F.count("*").alias("n"), F.min("t").alias("_s"), F.max("t").alias("_e"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"),
    )
    rows = by_axis.hint("merge").join(peaks, [key, axis], "left").withColumn("status", F.when(F.size("peaks") > 0, "ok").otherwise("no_peaks"))
    nested = F.struct(F.col(axis).alias("axis"), "status", "n", "mean", "std", "rms", "low", "high", (F.col("_q")[1] - F.col("_q")[0]).alias("span90"), "peaks")
    out = rows.groupBy(key).agg(F.sum("n").alias("rows"), F.min("_s").alias("start"), F.max("_e").alias("end"), F.array_sort(F.collect_list(nested)).alias("axes"))
    ends = (F.col("start"), F.col("end"), start, end)
    out = out.withColumns({
        "duration": F.col("end") - F.col("start"), "overlap": overlap(*ends), "gap": F.when(overlap(*ends) > 0, 0.0).otherwise(gap(*ends)),
        "start_difference": F.col("start") - start, "end_difference": F.col("end") - end,
    }).withColumn("overlap_percent", 100.0 * F.col("overlap") / F.greatest(end - start, F.lit(1e-12)))
    every = F.flatten(F.transform("axes", lambda x: F.transform(F.coalesce(x["peaks"], F.array()), lambda p: F.struct(F.round(p["error"], 9).alias("by"), x["axis"].alias("axis"), p["rank"].alias("rank"), p["frequency"].alias("frequency"), p["strength"].alias("strength"), p["error"].alias("error")))))
    out = out.withColumn("_all", F.filter(every, lambda p: p["error"].isNotNull()))
    out = out.withColumns({"_any": F.array_min("_all"), "_best": F.array_min(F.filter("_all", lambda p: p["rank"] == 1))})
    best = {"best_axis": "_best.axis", "best_frequency": "_best.frequency", "best_error": "_best.error", **{f"any_{c}": f"_any.{c}" for c in ("axis", "rank", "frequency", "strength", "error")}}
    return out.withColumns({name: F.col(c) for name, c in best.items()}).drop("_all", "_any", "_best")


def within(margin: Column) -> Column:
    """Whether a measurement overlaps the video or is at most `margin` away."""
    return (F.col("overlap") > 0) | (F.col("gap") <= margin)


def window_counts(found: DataFrame, margins: list[float], threshold: float) -> DataFrame:
    """For each margin of time, which include each other: measurements within it (temporal), those of them with a peak at most `threshold` percent off
    (simultaneous), the smallest gap of the first and the smallest error of the second."""
    near, alike = within(F.col("margin")), F.col("any_error") <= threshold
    rows = found.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    return rows.groupBy("margin").agg(F.count_if(near).alias("temporal"), F.count_if(near & alike).alias("simultaneous"), F.min(F.when(near, F.col("gap"))).alias("best_gap"), F.min(F.when(near & alike, F.col("any_error"))).alias("best_error"))


def search_summary(found: DataFrame, margin: float, margins: list[float], threshold: float) -> DataFrame:
    """One row: measurements, those in time, with a good strongest peak, with any good peak, and with both within the margin; and what follows.

    Where none has both, the margins are walked upwards: the first with a match, its matches, and the last margin with one. The conclusion is
    "matched", "exploratory" (matches within wider margins only) or "none".
    """
    near, alike = within(F.lit(float(margin))), F.col("any_error") <= threshold
    one = found.agg(F.count("*").alias("measurements"), F.count_if(near).alias("temporal"), F.count_if(F.col("best_error") <= threshold).alias("dominant"), F.count_if(alike).alias("any_peak"), F.count_if(near & alike).alias("simultaneous"))
    steps = window_counts(found, margins, threshold).where("simultaneous > 0").agg(F.min(F.struct("margin", "simultaneous")).alias("_first"), F.max(F.struct("margin", "simultaneous")).alias("_last"))
    both = one.withColumn("_k", F.lit(1)).join(steps.withColumn("_k", F.lit(1)), "_k")
    direct = F.col("simultaneous") > 0
    return both.select(
        "measurements", "temporal", "dominant", "any_peak", "simultaneous",
        F.when(direct, F.lit(float(margin))).otherwise(F.col("_first.margin")).alias("earliest_margin"), F.when(direct, F.col("simultaneous")).otherwise(F.coalesce("_first.simultaneous", F.lit(0))).alias("earliest_count"),
        F.when(~direct, F.col("_last.margin")).alias("widest_margin"), F.when(~direct, F.col("_last.simultaneous")).alias("widest_count"),
        F.when(direct, "matched").when(F.col("_first").isNotNull(), "exploratory").otherwise("none").alias("conclusion"),
    )


def scored(candidates: DataFrame, reference: float) -> DataFrame:
    """Frequency error against a reference and the combined score with the correlation."""
    error = relative_error(F.col("frequency"), F.lit(reference))
    return candidates.withColumn("error", error).withColumn("score", match_score(F.col("r"), F.col("error")))


def canonical(runs: DataFrame, full_share: float = 0.99) -> DataFrame:
    """All runs with their rank within (method, video): full length first, then observed, successful, points, path; rank 1 is chosen."""
    full = F.col("observed") >= F.ceil(F.col("expected") * full_share)
    w = Window.partitionBy("method", "video_id")
    order = w.orderBy(F.desc("full_length"), F.desc("observed"), F.desc("successful"), F.desc("points"), F.desc("path"))
    rows = runs.withColumn("full_length", full)
    return rows.withColumns({"rank": F.row_number().over(order), "candidates": F.count("*").over(w)}).withColumn("chosen", F.col("rank") == 1)


def coverage(runs: DataFrame) -> DataFrame:
    """Coverage, conditional and effective rate in percent; null where the denominator is zero."""
    pct = lambda a, b: F.when(F.col(b) != 0, 100.0 * F.col(a) / F.col(b))
    return runs.withColumns({"coverage": pct("observed", "expected"), "conditional": pct("successful", "observed"), "effective": pct("successful", "expected")})


def method_summary(runs: DataFrame) -> DataFrame:
    """Of each method: chosen runs, full-length ones and their weighted rate, mean, median and extremes of the effective rate."""
    full = lambda c: F.when(F.col("full_length"), F.col(c))
    out = runs.groupBy("method").agg(
        F.count("*").alias("runs"), F.count(full("video_id")).alias("full"), (100.0 * F.sum(full("successful")) / F.sum(full("expected"))).alias("weighted"),
        F.avg("effective").alias("mean"), F.percentile("effective", F.lit(0.5)).alias("median"), F.min("effective").alias("low"), F.max("effective").alias("high"),
    )
    return out.withColumn("partial", F.col("runs") - F.col("full"))
