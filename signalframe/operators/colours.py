"""Colour modes of pixel tables by name, and what runs under several configurations yield side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of the colour modes.
MODES = ("gray", "r", "g", "b", "hsv_h", "hsv_s", "hsv_v")

#: Fixed names of the measures by which configurations are compared, in the order of the report.
MEASURES = ("avg_processing_time_s", "avg_pipeline_fps", "avg_track_count", "average_track_length", "num_unique_tracks", "num_large_jumps", "mean_bed_edge_y", "std_bed_edge_y", "mean_temporal_iou")


def channel(r: Column, g: Column, b: Column, mode: str) -> Column:
    """The whole number 0..255 that a colour mode takes from a pixel; an unknown mode counts as gray, a null channel gives null.

    The hue is half of its degrees, 0..179, and 0 for gray pixels; saturation is 0 for black ones. Halves are rounded up, so values may be
    one off those of kernels in fixed-point arithmetic.
    """
    if mode in ("r", "g", "b"):
        return {"r": r, "g": g, "b": b}[mode].cast("long")
    known = r.isNotNull() & g.isNotNull() & b.isNotNull()
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    if mode == "hsv_v":
        value = top
    elif mode == "hsv_s":
        value = F.when(top > 0, F.floor(255.0 * span / top + 0.5)).otherwise(0)
    elif mode == "hsv_h":
        turn = F.when(top == r, 30.0 * (g - b) / span).when(top == g, 60 + 30.0 * (b - r) / span).otherwise(120 + 30.0 * (r - g) / span)
        value = F.when(span > 0, F.pmod(F.floor(turn + 0.5), F.lit(180))).otherwise(0)
    else:
        value = F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    return F.when(known, value).cast("long")


def by_mode(pixels: DataFrame, modes: Sequence[str] = MODES, out: str = "v") -> DataFrame:
    """Each pixel (r, g, b, others) once a mode: the others, place (of the mode in the list, from 0), mode, and its value in `out`."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("mode"), channel(F.col("r"), F.col("g"), F.col("b"), m).alias(out)) for i, m in enumerate(modes)])
    others = [c for c in pixels.columns if c not in ("r", "g", "b")]
    return pixels.select(*others, F.explode(cells).alias("_c")).select(*others, "_c.*")


def configurations(summaries: DataFrame, names: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Long summaries (configuration, metric, value) side by side: place, configuration, each measure, and by how much it differs from that of the first name.

    One row per name, in the given order, null for what its summary lacks; other configurations and metrics are left out. Of
    repeated metrics the largest value counts.
    """
    wide = summaries.groupBy("configuration").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in measures])
    listed = summaries.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, configuration string")
    rows = F.broadcast(listed).join(wide, "configuration", "left")  # a row per name on both sides
    first = rows.where("place = 0").select(*[F.col(m).alias(f"_{m}") for m in measures])
    return rows.crossJoin(F.broadcast(first)).select("place", "configuration", *measures, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_difference") for m in measures])
