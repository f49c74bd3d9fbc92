"""Extraction success of the four methods from their own result tables, and rules on labels and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions.scalars import ladder, number
from signalframe.operators.matching import coverage

#: Fixed words of the success column.
SUCCESS = ("1", "true", "ok", "valid", "success", "detected")


def succeeded(c: Column) -> Column:
    """A success column of numbers or words as a boolean: above zero, or one of the fixed words."""
    return F.coalesce(number(c) > 0, F.lower(F.trim(c)).isin(*SUCCESS), F.lit(False))


def label_class(label: Column) -> Column:
    """Class of an annotation label by its fixed suffix; null without one."""
    return F.when(F.endswith(label, F.lit("_inner_pipe")), "inner_pipe").when(F.endswith(label, F.lit("_particle_bed")), "particle_bed")


def shape_counts(shapes: DataFrame, points: Column, keys: list[str]) -> DataFrame:
    """Of each frame the usable shapes of both classes (three points or more), those with fewer points, ignored labels, and whether it has no shape.

    shapes has a label, null in the one row of a frame without shapes; points is the number of a shape's points.
    """
    some, kind, enough = F.col("label").isNotNull(), label_class(F.col("label")), F.coalesce(points, F.lit(0)) >= 3
    return shapes.groupBy(*keys).agg(
        *[F.count_if((kind == c) & enough).alias(f"{c}_shapes") for c in ("inner_pipe", "particle_bed")], F.count_if(kind.isNotNull() & ~enough).alias("short_shapes"),
        F.count_if(some & kind.isNull()).alias("ignored_labels"), (F.count_if(some) == 0).alias("empty"),
    )


def roi_at_edge(regions: DataFrame, edges: DataFrame, offset: int, height: int, frame_width: int, frame_height: int) -> DataFrame:
    """Regions (frame, x, y, w, h) moved to offset below the bed edge (frame, edge) of their frame and kept inside it.

    A region whose frame has no edge stays as it is.
    """
    y = F.greatest(F.lit(0), F.least((F.col("edge") + offset).cast("int"), F.lit(frame_height - 1)))
    x = F.greatest(F.lit(0), F.least(F.col("x"), F.lit(frame_width - 1)))
    moved = F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.least(F.col("w"), frame_width - x)).alias("w"), F.greatest(F.lit(1), F.least(F.lit(height), frame_height - y)).alias("h"))
    rows = regions.join(edges, "frame", "left").withColumn("_roi", F.when(F.col("edge").isNotNull(), moved))
    return rows.withColumns({c: F.coalesce(F.col(f"_roi.{c}"), F.col(c)).cast("long") for c in "xywh"}).drop("_roi")


def with_diagnostics(frames: DataFrame, diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with the diagnostics of the same keys, null where there are none. Repeated diagnostics are an error of the caller's data: the first by value counts."""
    rest = [c for c in diagnostics.columns if c not in keys]
    one = diagnostics.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_d")).select(*keys, "_d.*")
    return frames.join(one, keys, "left")


def with_rates(found: DataFrame, sources: DataFrame, transitions: bool, full_share: float = 0.99) -> DataFrame:
    """Every video of sources (video_id, source_frames) with observed, successful, expected frames, their rates, missing and failed frames, and whether it is of full length.

    Expected are the frames, or with transitions one less, but not below zero. A video without rows has none observed. No more frames succeed than
    are observed. Full length means that at least full_share of some expected frames (rounded up) are observed.
    """
    expected = F.greatest(F.col("source_frames") - 1, F.lit(0)) if transitions else F.col("source_frames")
    rows = sources.join(found, "video_id", "left").withColumn("expected", F.greatest(expected, F.lit(0)))
    rows = coverage(rows.withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("successful", F.least(F.coalesce("successful", F.lit(0)), "observed")))
    full = (F.col("expected") > 0) & (F.col("observed") >= F.ceil(F.col("expected") * full_share))
    return rows.withColumns({"missing": F.greatest(F.col("expected") - F.col("observed"), F.lit(0)), "failed": F.col("observed") - F.col("successful"), "full_length": full})


def tracked_point_success(points: DataFrame, sources: DataFrame, min_valid: int) -> DataFrame:
    """Point tracker: a frame succeeds with min_valid valid points or more; also shares of valid points, their errors and jumps."""
    rows = points.where("frame is not null and point_id is not null and status is not null")
    frames = rows.groupBy("video_id", "frame").agg(F.count("*").alias("points"), F.sum("status").alias("valid"))
    per_video = frames.groupBy("video_id").agg(
        F.count("*").alias("observed"), F.count_if(F.col("valid") >= min_valid).alias("successful"), F.sum("points").alias("points"),
        F.percentile("valid", F.lit(0.5)).alias("median_valid"), F.min("valid").alias("min_valid"), F.max("valid").alias("max_valid"),
    )
    good = rows.where("status = 1").groupBy("video_id").agg(F.count("*").alias("valid_points"), *[F.percentile(c, F.lit(q)).alias(f"{name}_{c}") for c in ("fb_error", "jump_px") for q, name in ((0.5, "median"), (0.95, "p95"))])
    found = per_video.join(good, "video_id", "left").withColumn("point_success", 100.0 * F.coalesce("valid_points", F.lit(0)) / F.col("points"))
    return with_rates(found, sources, True)


def frame_success(rows: DataFrame, sources: DataFrame, success: Column, transitions: bool) -> DataFrame:
    """Dense flow, detector and classical results: a frame is observed with any row and succeeds with one for which success holds."""
    good = F.when(F.coalesce(success, F.lit(False)), F.col("frame"))
    found = rows.where("frame is not null").groupBy("video_id").agg(F.count_distinct("frame").alias("observed"), F.count_distinct(good).alias("successful"))
    return with_rates(found, sources, transitions)


#: Fixed columns that say whether a frame succeeded, the first that a result table has counts.
DETECTOR_SUCCESS = ("detection_success", "segmentation_valid", "detected", "status")
CLASSICAL_SUCCESS = ("inner_pipe_detected", "inner_pipe_valid", "segmentation_valid", "detection_success", "status")


def reported_success(rows: DataFrame, sources: DataFrame, columns: tuple[str, ...], score: str | None = None, full_share: float = 0.99) -> DataFrame:
    """Detector and classical results by what their tables report, with success_column and the rule that was used.

    The first of `columns` that rows has decides. Booleans count as they are; where a video's column has a number anywhere, a row succeeds above zero, else
    by the fixed words. Without such a column a row with a finite `score` succeeds if rows has that, and otherwise every row with a
    frame. Frames that are no numbers count for nothing. One grouping by video.
    """
    chosen = next((c for c in columns if c in rows.columns), None)
    real = lambda c: F.when(~F.isnan(number(c)), number(c))
    frame = real(F.col("frame").cast("string"))
    if chosen:
        text = F.col(chosen).cast("string")
        value = real(F.col(chosen).cast("int").cast("string") if dict(rows.dtypes)[chosen] == "boolean" else text)
        count = F.when(F.max(value.isNotNull()), F.count_distinct(F.when(value > 0, frame))).otherwise(F.count_distinct(F.when(F.lower(F.trim(text)).isin(*SUCCESS), frame)))
        rule = "column"
    elif score and score in rows.columns:
        count, rule = F.count_distinct(F.when(real(F.col(score).cast("string")).isNotNull(), frame)), "score"
    else:
        count, rule = F.count_distinct(frame), "represented"
    found = rows.groupBy("video_id").agg(F.count_distinct(frame).alias("observed"), count.alias("successful"))
    return with_rates(found, sources, False, full_share).withColumns({"success_column": F.lit(chosen or ""), "rule": F.lit(rule)})


def any_finite(*columns: str) -> Column:
    """Whether one of the columns has a number."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return out


def rate_verdict(rate: Column) -> Column:
    return ladder([(rate >= 95, "complete"), (rate >= 50, "partial")], "low")
