"""Pixel tables: brightness, histograms, thresholds, mask overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brightness(pixels: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Mean and median gray value of each frame, or of its region (x, y, width, height); a frame without pixels there has none."""
    if roi:
        x, y, w, h = roi
        pixels = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return pixels.groupBy("frame").agg(F.avg("v").alias("mean_v"), F.percentile("v", F.lit(0.5)).alias("med_v"), F.count("*").alias("n"))


def with_gain(pixels: DataFrame, target: float) -> DataFrame:
    """Pixels scaled so that each frame has the target brightness, cut to 0..255."""
    gains = pixels.groupBy("frame").agg(F.avg("v").alias("_m"))
    rows = pixels.join(gains, "frame").withColumn("gain", F.when(F.col("_m") > 0, target / F.col("_m")).otherwise(1.0))
    return rows.withColumn("out", F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v") * F.col("gain")))).drop("_m")


def histogram(pixels: DataFrame) -> DataFrame:
    """Of each frame and gray value: pixels, and pixels up to it. At most 256 rows per frame."""
    w = Window.partitionBy("frame").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.groupBy("frame", "v").agg(F.count("*").alias("n")).withColumn("up_to", F.sum("n").over(w))


def otsu(pixels: DataFrame) -> DataFrame:
    """Of each frame the threshold of the largest variance between classes (ties to the lower)."""
    w = Window.partitionBy("frame")
    before = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.groupBy("frame", "v").agg(F.count("*").alias("n")).withColumn("s", F.col("n") * F.col("v"))
    rows = rows.withColumns({"n0": F.sum("n").over(before), "s0": F.sum("s").over(before), "nt": F.sum("n").over(w), "st": F.sum("s").over(w)}).where("n0 < nt")
    n1 = F.col("nt") - F.col("n0")
    means = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1
    rows = rows.withColumn("between", F.col("n0") * n1 * means * means)
    return rows.groupBy("frame").agg(F.max_by("v", F.struct(F.round("between", 6), -F.col("v"))).alias("threshold"), F.max("between").alias("between"))


def equalised(pixels: DataFrame) -> DataFrame:
    """Gray values spread by the cumulative histogram; a flat frame stays as it is."""
    w = Window.partitionBy("frame")
    h = histogram(pixels).withColumns({"_first": F.min("up_to").over(w), "_all": F.max("up_to").over(w)})
    spread = F.col("_all") - F.col("_first")
    h = h.select("frame", "v", F.when(spread > 0, F.round(255.0 * (F.col("up_to") - F.col("_first")) / spread)).otherwise(F.col("v")).cast("long").alias("equalised"))
    return pixels.join(h, ["frame", "v"])


def overlap_counts(truth: DataFrame, predicted: DataFrame, total: int) -> DataFrame:
    """Of each frame of foreground pixel tables (frame, px): tp, fp, fn, tn, iou, dice (0 when both are empty), area ratio."""
    a = truth.select("frame", "px").distinct().withColumn("a", F.lit(1))
    b = predicted.select("frame", "px").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["frame", "px"], "full_outer").groupBy("frame").agg(
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("a").isNull(), 1)).alias("fp"), F.count(F.when(F.col("b").isNull(), 1)).alias("fn")
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return both.withColumns({
        "tn": F.lit(total) - tp - fp - fn,
        "iou": F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(0.0),
        "dice": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0),
        "area_ratio": F.when(tp + fn > 0, (tp + fp) / (tp + fn)),
    })


def temporal_overlap(frames: DataFrame, on: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the IoU of the foreground pixels (frame, px) of consecutive frames; 1.0 where both are empty.

    With `by` a frame has a mask for each value of these columns, and masks of one value are compared. px is a whole number; 64 pixels of a
    mask become the bits of one number where they lie, so no table of pixels is joined.
    """
    name = ["frame", *(by or [])]
    before = (F.col("frame") - 1).alias("frame")
    pairs = frames.select(*dict.fromkeys([*name, *keys])).join(frames.select(before, *name[1:]), name)
    bits = on.groupBy(*name, F.floor(F.col("px") / 64).alias("_part")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(px, 64) as int)))").alias("_bits"))
    none, own = F.lit(0).cast("long"), F.col("_bits")
    sides = F.array(F.struct(F.col("frame"), own.alias("a"), none.alias("b")), F.struct(before, none.alias("a"), own.alias("b")))
    parts = bits.select(*name[1:], "_part", F.explode(sides).alias("_s")).select(*name[1:], "_part", "_s.*").groupBy(*name, "_part").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    shared, either = F.col("a").bitwiseAND(F.col("b")), F.col("a").bitwiseOR(F.col("b"))
    each = parts.groupBy(*name).agg((F.sum(F.bit_count(shared)) / F.sum(F.bit_count(either))).alias("iou"))
    return pairs.join(each, name, "left").groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg(F.coalesce("iou", F.lit(1.0))).alias("mean_iou"), F.stddev_pop(F.coalesce("iou", F.lit(1.0))).alias("std_iou"))


def edge_rows(pixels: DataFrame, expected: float, sigma: float, taps: int = 3, least: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Of each frame the row where the mean absolute vertical step, weighed by a prior around the expected row and smoothed over `taps` rows, is largest.

    With `least`, success says whether the signal reaches it; the row is null where it does not. With `by` a frame has an image for each value of these columns.
    """
    name = ["frame", *(by or [])]
    column = Window.partitionBy(*name, "x").orderBy("y")
    steps = pixels.withColumn("d", F.abs(F.lead("v").over(column) - F.lag("v").over(column)) / 2).where("d is not null")
    prior = F.exp(-0.5 * ((F.col("y") - expected) / sigma) ** 2)
    profile = steps.groupBy(*name, "y").agg(F.avg("d").alias("d")).withColumn("s", F.col("d") * prior)
    near = Window.partitionBy(*name).orderBy("y").rowsBetween(-(taps // 2), taps // 2)
    profile = profile.withColumn("s", F.avg("s").over(near))
    out = profile.groupBy(*name).agg(F.max_by("y", F.struct(F.round("s", 6), -F.col("y"))).alias("edge"), F.max("s").alias("signal"))
    if least is None:
        return out
    return out.withColumn("success", F.col("signal") >= least).withColumn("edge", F.when(F.col("success"), F.col("edge")))


def same_aspect(tolerance: float = 1e-3) -> Column:
    """Whether height x width and to_height x to_width have one ratio of width to height but for a relative tolerance; false for sides that are null or not above 0."""
    sides = F.least("height", "width", "to_height", "to_width") > 0
    wanted, given = F.col("to_width") / F.when(sides, F.col("to_height")), F.col("width") / F.when(sides, F.col("height"))
    known = F.col("height").isNotNull() & F.col("width").isNotNull() & F.col("to_height").isNotNull() & F.col("to_width").isNotNull()
    return known & F.coalesce(F.abs(wanted - given) <= 1e-8 + tolerance * given, F.lit(False))


def fitted(masks: DataFrame, sizes: DataFrame, keys: list[str], tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Masks (keys, y, x, value) brought to the size of those that they are compared with by nearest neighbours, and the masks that cannot be.

    sizes has one row a mask: keys, height, width, to_height, to_width. Pixel y of the new mask is pixel floor(y * height / to_height) of the old
    one, and is on where that one is above 0 (null: off). The first table has keys, y, x, on; the second the sizes of masks of another
    aspect or without a size. Every old pixel is sent to the new ones that it is, so no table of new pixels is joined.
    """
    sizes = sizes.withColumn("_good", same_aspect(tolerance))
    rows = masks.select(*keys, "y", "x", "value").join(sizes.where("_good"), keys)

    def first(c: str, size: str, to: str, more: int) -> Column:
        return F.expr(f"cast((({c} + {more}) * {to} + {size} - 1) div {size} as long)")

    rows = rows.withColumns({"_y0": first("y", "height", "to_height", 0), "_y1": first("y", "height", "to_height", 1) - 1, "_x0": first("x", "width", "to_width", 0), "_x1": first("x", "width", "to_width", 1) - 1})
    rows = rows.where("_y0 <= _y1 and _x0 <= _x1").select(*keys, F.explode(F.sequence("_y0", "_y1")).alias("y"), "_x0", "_x1", F.coalesce(F.col("value") > 0, F.lit(False)).alias("on"))
    return rows.select(*keys, "y", F.explode(F.sequence("_x0", "_x1")).alias("x"), "on"), sizes.where(~F.col("_good")).drop("_good")
