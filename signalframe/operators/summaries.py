"""Summaries of whole runs and recordings, and what lies beside a frame: its objects, its trail, its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions.scalars import ladder
from signalframe.operators import series
from signalframe.operators.blocks import percentiles


def detector_run(frames: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: frames (keys, frame, has_detection, compute_time) and objects (keys, score, area) side by side.

    Frame level: processed, with and without detections, rate in percent, mean, median and 95 % point of the time, fps from the mean. Object level: objects,
    mean and median score, mean area. A run without objects has nulls there; one without frames is not a run.
    """
    times = percentiles(frames, keys, ["compute_time"], [0.5, 0.95]).select(*keys, F.col("compute_time")[0].alias("median_time"), F.col("compute_time")[1].alias("p95_time"))
    by_frame = frames.groupBy(*keys).agg(F.count("*").alias("processed"), F.count_if(F.col("has_detection") > 0).alias("with_detections"), F.avg("compute_time").alias("mean_time"))
    medians = percentiles(detections, keys, ["score"], [0.5]).select(*keys, F.col("score")[0].alias("median_score"))
    by_object = detections.groupBy(*keys).agg(F.count("*").alias("objects"), F.avg("score").alias("mean_score"), F.avg("area").alias("mean_area"))
    out = by_frame.join(times, keys, "left").join(by_object, keys, "left").join(medians, keys, "left")
    return out.withColumns({
        "without_detections": F.col("processed") - F.col("with_detections"), "output_rate": 100.0 * F.col("with_detections") / F.col("processed"),
        "fps": F.when(F.col("mean_time") > 0, 1 / F.col("mean_time")), "objects": F.coalesce("objects", F.lit(0)),
    })


def benchmark_row(runs: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run of runs (keys, source_frames, start_frame, end_frame, runtime; end exclusive) with its frames (keys, frame, has_detection).

    expected, processed, with and without detections, coverage and output rate in percent, mean time of a frame, effective fps, and whether the whole source was processed.
    A run without frames has coverage 0 and neither rate nor times.
    """
    done = frames.groupBy(*keys).agg(F.count("*").alias("processed"), F.count_if(F.col("has_detection") > 0).alias("with_detections"))
    rows = runs.join(done, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("processed", "with_detections")})
    n, some = F.col("processed"), F.col("processed") > 0
    rows = rows.withColumn("expected", F.col("end_frame") - F.col("start_frame"))
    return rows.withColumns({
        "without_detections": n - F.col("with_detections"), "coverage": F.when(some & (F.col("expected") > 0), 100.0 * n / F.col("expected")).otherwise(0.0), "output_rate": F.when(some, 100.0 * F.col("with_detections") / n),
        "frame_time": F.when(some, F.col("runtime") / n), "fps": F.when(some & (F.col("runtime") > 0), n / F.col("runtime")),
        "full_length": (F.col("start_frame") == 0) & (n == F.col("source_frames")) & (F.col("end_frame") == F.col("source_frames")),
    })


def time_base(frames: DataFrame, keys: list[str], span: float = 3600.0) -> DataFrame:
    """Of each run the median step between the times of its frames (keys, t; each time once) and the frame rate it means."""
    rows = series.blocks_of_times(frames, keys, span)
    steps = percentiles(rows, keys, ["dt"], [0.5]).select(*keys, F.col("dt")[0].alias("median_step"))
    return steps.withColumn("fps", F.when(F.col("median_step") > 0, 1 / F.col("median_step")))


#: Fixed limits of the verdict on a point.
LEAST_SAMPLES, LEAST_SUCCESS, MOST_JUMP = 10, 0.8, 3.0


def point_motion(points: DataFrame, dominant: DataFrame) -> DataFrame:
    """Of each point: samples, valid ones and their share, half ranges and root mean squares of x and y from the first valid sample, means, jumps, dominant frequency, verdict.

    points: point_id, t, x, y, jump_px, status; dominant: point_id, frequency, of the valid y. Reasons are "too_few_valid_samples" (measures are null then),
    "low_quality_tracking" and "ok". The first sample is the earliest.
    """
    ok = F.col("status") == 1
    first = points.where(ok).groupBy("point_id").agg(F.min_by("x", "t").alias("_x"), F.min_by("y", "t").alias("_y"))
    rows = points.join(first, "point_id", "left").withColumns({"_ux": F.when(ok, F.col("x") - F.col("_x")), "_uy": F.when(ok, F.col("y") - F.col("_y"))})
    valid = lambda c: F.when(ok, F.col(c))
    out = rows.groupBy("point_id").agg(
        F.count("*").alias("total_samples"), F.count_if(ok).alias("num_samples"),
        *[((F.max(f"_u{c}") - F.min(f"_u{c}")) / 2).alias(f"amp_{c}") for c in "xy"], *[F.sqrt(F.avg(F.col(f"_u{c}") * F.col(f"_u{c}"))).alias(f"rms_{c}") for c in "xy"],
        *[F.avg(valid(c)).alias(f"mean_{c}") for c in "xy"], F.avg(valid("jump_px")).alias("mean_jump"), F.max(valid("jump_px")).alias("max_jump"),
    ).join(dominant.select("point_id", F.col("frequency").alias("dominant")), "point_id", "left")
    enough = F.col("num_samples") >= LEAST_SAMPLES
    out = out.withColumn("success_rate", F.col("num_samples") / F.col("total_samples"))
    good = enough & (F.col("success_rate") >= LEAST_SUCCESS) & F.coalesce(F.col("mean_jump") <= MOST_JUMP, F.lit(True)) & F.col("dominant").isNotNull()
    measures = [f"{m}_{c}" for m in ("amp", "rms", "mean") for c in "xy"] + ["mean_jump", "max_jump", "dominant"]
    out = out.withColumns({m: F.when(enough, F.col(m)) for m in measures})
    return out.withColumns({"valid": good, "reason": ladder([(~enough, "too_few_valid_samples"), (good, "ok")], "low_quality_tracking")})


def objects_by_frame(frames: DataFrame, objects: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Every frame (keys) with the array of its objects' fields, in the order of these; empty where it has none."""
    lists = objects.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("objects"))
    return frames.join(lists, keys, "left").withColumn("objects", F.coalesce("objects", F.array()))


def trails(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each frame of `rows` (keys, frame, other columns) beside the rows of its trail, those of the same keys in the n frames up to it: keys, at, frame, others.

    Every row is sent to the frames that it trails, so this is an equi-join, and frames without rows have no trail.
    """
    sent = rows.withColumn("at", F.explode(F.sequence(F.col("frame"), F.col("frame") + n - 1)))
    there = rows.select(*keys, F.col("frame").alias("at")).distinct()
    return sent.join(there, [*keys, "at"])


def manifest(chosen: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """The chosen frames with a flag found_<name> for each table that has the frame, and the names of those that lack it, comma-joined, in the order given."""
    out = chosen.select(key).distinct()
    for name, rows in tables.items():
        out = out.join(rows.select(key).distinct().withColumn(f"found_{name}", F.lit(True)), key, "left").withColumn(f"found_{name}", F.coalesce(f"found_{name}", F.lit(False)))
    return out.withColumn("missing", F.concat_ws(",", *[F.when(~F.col(f"found_{name}"), F.lit(name)) for name in tables]))


def distribution(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of each group and column: mean, median, population deviation, least and largest value."""
    middle = percentiles(rows, keys, columns, [0.5]).select(*keys, *[F.col(c)[0].alias(f"median_{c}") for c in columns])
    rest = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    return rest.join(middle, keys, "left")


def physical_agreement(failed: Column, decaying: Column, damping_error: Column, frequency_error: Column, envelope: Column) -> Column:
    """Fixed ladder over errors in percent and the correlation of the envelopes (null counts as none)."""
    near = F.coalesce(envelope, F.lit(-1.0))
    return ladder([
        (F.coalesce(failed, F.lit(False)), "analysis_failed"), (~F.coalesce(decaying, F.lit(False)), "decay_not_confirmed"), (damping_error.isNull() | frequency_error.isNull(), "insufficient_metrics"),
        ((damping_error <= 10) & (frequency_error <= 5) & (near >= 0.8), "strong_physical_agreement"), ((damping_error <= 25) & (frequency_error <= 10) & (near >= 0.5), "moderate_physical_agreement"),
        ((damping_error <= 50) & (frequency_error <= 20), "weak_physical_agreement"),
    ], "no_physical_agreement")


def time_similarity(correlation: Column) -> Column:
    """Fixed ladder over the best axis' absolute correlation; null, where no axis succeeded, is its own label."""
    return ladder([(correlation.isNull(), "validation_failed"), *[(correlation >= c, f"{name}_time_domain_similarity") for c, name in ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))]], "no_direct_time_domain_similarity")


#: Normalisations by name: each adds the column `out`.
NORMALISATIONS = {"zscore": series.zscore, "minmax": series.minmax, "robust": series.robust, "none": lambda rows, keys, out: rows.withColumn(out, F.col("value"))}


def normalised(rows: DataFrame, method: str, keys: list[str] = series.KEYS, out: str = "normalised") -> DataFrame:
    """value by the normalisation of that name, in any case of letters; an unknown name is an error."""
    if method.lower() not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {method!r}; there are {', '.join(NORMALISATIONS)}")
    return NORMALISATIONS[method.lower()](rows, keys, out)
