"""Tracked points: references, displacements, robust frame aggregates, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.operators.blocks import first_rows, percentiles


def median(c) -> F.Column:
    return F.percentile(c, F.lit(0.5))


def references(points: DataFrame, n: int = 20) -> DataFrame:
    """Of each point the medians of its first n positions."""
    first = first_rows(points.select("point_id", "frame", "x", "y"), ["point_id"], [F.col("frame")], n)
    return first.groupBy("point_id").agg(median("x").alias("ref_x"), median("y").alias("ref_y"), F.count("*").alias("ref_n"))


def displaced(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Displacement of each point from its reference: ux, uy and their magnitude.

    The references, one small row a point, are broadcast: a frame has few points, so their numbers would leave a join by point to a few tasks.
    """
    rows = points.join(F.broadcast(reference), "point_id").withColumns({"ux": F.col("x") - F.col("ref_x"), "uy": F.col("y") - F.col("ref_y")})
    return rows.withColumn("u", F.hypot("ux", "uy"))


def middle(c: str) -> F.Column:
    """The median of a small group by its sorted values; cheaper by far than median(), whose every group starts a table of counts."""
    values, n = F.sort_array(F.collect_list(F.col(c).cast("double"))), F.count(c)
    at = lambda i: F.get(values, F.floor(i).cast("int"))
    return F.when(n % 2 == 1, at(n / 2)).otherwise(0.5 * at(n / 2 - 1) + 0.5 * at(n / 2))


def by_frame(points: DataFrame, least: int = 2) -> DataFrame:
    """Robust motion of each frame with at least `least` points. The values of a frame meet in one row of a task."""
    out = points.groupBy("frame", "t").agg(
        F.size(F.collect_set("point_id")).cast("long").alias("n_points"),
        *[middle(c).alias(f"med_{c}") for c in ("x", "y", "ux", "uy", "dx", "dy", "jump_px", "fb_error")],
        F.max("jump_px").alias("max_jump"),
        F.max("fb_error").alias("max_fb"),
        F.stddev_samp("uy").alias("std_uy"),
        (F.max("uy") - F.min("uy")).alias("range_uy"),
    )
    return out.where(F.col("n_points") >= least).withColumn("med_u", F.hypot("med_ux", "med_uy"))


def diagnostics(points: DataFrame, ids: list[int], measures: tuple[str, ...] = ("x", "y", "jump_px", "fb_error")) -> DataFrame:
    """One row per frame with the measures of each listed point side by side."""
    cells = [F.first(F.when(F.col("point_id") == i, F.col(m)), ignorenulls=True).alias(f"p{i}_{m}") for i in ids for m in measures]
    return points.groupBy("frame", "t").agg(*cells)


def point_statistics(points: DataFrame, ok: Column) -> DataFrame:
    """Of each point: rows, rows that pass the test and their share, error medians and maxima of these, first and last frame."""
    out = points.groupBy("point_id").agg(
        F.count("*").alias("n_rows"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.count_if(ok).alias("n_valid"), F.max(F.when(ok, F.col("fb_error"))).alias("max_fb"), F.max(F.when(ok, F.col("jump_px"))).alias("max_jump"),
    )
    medians = percentiles(points.where(ok), ["point_id"], ["fb_error", "jump_px"], [0.5]).select("point_id", F.col("fb_error")[0].alias("med_fb"), F.col("jump_px")[0].alias("med_jump"))
    return out.join(medians, "point_id", "left").withColumn("valid_share", F.col("n_valid") / F.col("n_rows"))


def motion_summary(points: DataFrame) -> DataFrame:
    """Of each point: success rate, half range, RMS and mean of its valid displacements uy, mean jump."""
    ok = F.col("status") == 1
    uy = F.when(ok, F.col("uy"))
    return points.groupBy("point_id").agg(
        F.avg(ok.cast("double")).alias("success"), ((F.max(uy) - F.min(uy)) / 2).alias("amplitude"), F.sqrt(F.avg(uy * uy)).alias("rms"), F.avg(uy).alias("mean_uy"), F.avg(F.when(ok, F.col("jump_px"))).alias("mean_jump")
    )


def run_summary(points: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: frames in all and kept, their share, first and last time."""
    total = points.agg(F.count_distinct("frame").alias("n_frames"))
    kept = frames.agg(F.count("*").alias("n_kept"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("n_points").alias("mean_points"))
    return total.crossJoin(kept).withColumn("kept_share", F.col("n_kept") / F.col("n_frames"))
