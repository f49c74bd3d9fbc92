"""Quality filters, component rules and projections of tracked points, detections and signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.scalars import finite


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the columns it lacks; nothing is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def good_test(max_fb: float = 1.0, max_jump: float = 20.0, ids: list[int] | None = None) -> Column:
    """Whether a point has a good status, finite values and errors within the limits, and one of the given ids, if any."""
    test = (F.col("status") == 1) & (F.col("fb_error") <= max_fb) & (F.col("jump_px") <= max_jump)
    for c in ("x", "y", "fb_error", "jump_px"):
        test = test & finite(F.col(c))
    return test & F.col("point_id").isin(ids) if ids else test


def good_points(points: DataFrame, max_fb: float = 1.0, max_jump: float = 20.0, ids: list[int] | None = None) -> DataFrame:
    """Points that pass good_test."""
    return points.where(good_test(max_fb, max_jump, ids))


def gated(points: DataFrame, max_jump: float, max_fb: float) -> DataFrame:
    """accepted flag, and dx, dy set to 0 where a point is not accepted."""
    ok = (F.col("status") == 1) & (F.col("jump_px") <= max_jump) & (F.col("fb_error") <= max_fb)
    return points.withColumns({"accepted": ok, "dx": F.when(ok, F.col("dx")).otherwise(0.0), "dy": F.when(ok, F.col("dy")).otherwise(0.0)})


def valid_rows(df: DataFrame, flag: str, count: str) -> DataFrame:
    """Rows of valid tracks: by the flag column if there is one, else by a positive count, else all."""
    if flag in df.columns:
        return df.where(F.col(flag) == 1)
    return df.where(F.col(count) >= 1) if count in df.columns else df


def first_at_time(signals: DataFrame, keys: list[str], t: str, order: list[str]) -> DataFrame:
    """One row per time: the first in the given order."""
    w = Window.partitionBy(*keys, t).orderBy(*order)
    return signals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mean_at_time(signals: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    return signals.groupBy(*keys, t).agg(F.avg(value).alias(value))


@dataclass(frozen=True)
class Rule:
    """Limits of a component: least area, aspect (w / h), width and height, largest height; how many stay per frame."""

    area: float = 0.0
    aspect: float = 0.0
    width: int = 0
    height: int = 0
    most_height: int | None = None
    keep: int | None = None


#: Fixed limits by kind of object.
RULES = {
    "inner_pipe": Rule(120, 2.0, 80, 8, 70, 1),
    "bed": Rule(80, 3.0, 120, 8, 80, 1),
    "pipe": Rule(200, 1.5, 30),
    "box": Rule(80, 1.2, 10, 2, None, 3),
}


def by_rule(components: DataFrame, rule: Rule) -> DataFrame:
    """Components within the rule's limits, the largest `keep` of each frame (ties to the smaller object_id)."""
    aspect = F.col("w") / F.col("h")
    test = (F.col("area") >= rule.area) & (aspect >= rule.aspect) & (F.col("w") >= rule.width) & (F.col("h") >= rule.height)
    if rule.most_height is not None:
        test = test & (F.col("h") <= rule.most_height)
    found = components.where(test)
    if rule.keep is None:
        return found
    w = Window.partitionBy("frame").orderBy(F.desc("area"), "object_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rule.keep).drop("_n")


def refined(components: DataFrame, area: float, width: int, height: int) -> DataFrame:
    """The largest component of each frame above the limits, with its fill ratio (area by bounding box)."""
    big = components.where((F.col("area") >= area) & (F.col("w") >= width) & (F.col("h") >= height))
    best = big.groupBy("frame").agg(F.max_by(F.struct("object_id", "area", "w", "h"), F.struct("area", -F.col("object_id"))).alias("c"))
    return best.select("frame", "c.*", (F.col("c.area") / (F.col("c.w") * F.col("c.h"))).alias("fill"))


def boxes(components: DataFrame) -> DataFrame:
    """Centre and corners of x, y, w, h boxes."""
    return components.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2, "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"), "box_area": F.col("w") * F.col("h")})


def clamp(roi: tuple[int, int, int, int], width: int, height: int) -> tuple[int, int, int, int]:
    """An x, y, w, h region cut to the image; at least one pixel stays."""
    x, y, w, h = roi
    x, y = min(max(x, 0), width - 1), min(max(y, 0), height - 1)
    return x, y, max(1, min(w, width - x)), max(1, min(h, height - y))


def in_roi(pixels: DataFrame, roi: tuple[int, int, int, int], width: int, height: int) -> DataFrame:
    x, y, w, h = clamp(roi, width, height)
    return pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def moving(points: DataFrame, least: float) -> DataFrame:
    return points.where((F.abs("dx") > least) | (F.abs("dy") > least))
