"""Column expressions: ratios, scores, classifications, tolerant casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, null where the text is none."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def or_null(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(finite(c), c)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; null where whole is zero."""
    return F.when(whole != 0, 100.0 * part / whole)


def relative_error(value: Column, reference: Column) -> Column:
    """Absolute difference in percent of the reference; null where that is practically zero."""
    return F.when(F.abs(reference) >= 1e-8, 100.0 * F.abs(value - reference) / F.abs(reference))


def relative_difference(a: Column, b: Column, floor: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def weighted(parts: Mapping[str, float]) -> Column:
    """Weighted mean of the named columns that are not null; null if none is."""
    total = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items())
    return F.when(total > 0, sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()) / total)



def match_score(correlation: Column, error_percent: Column) -> Column:
    """0.7 of the absolute correlation and 0.3 of the frequency error's decay over 25 %."""
    return 0.7 * F.abs(correlation) + 0.3 * F.exp(-error_percent / 25.0)



def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for test, label in steps:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def video_id(name: Column, path: Column) -> Column:
    """GX followed by digits, in upper case, from the name or else the path; null without one."""
    found = [F.regexp_extract(F.upper(c), r"(GX\d+)", 1) for c in (name, path)]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def measurement_id(path: Column) -> Column:
    """The date and time in the name of a file's folder, such as 2022-04-17_10.20.30, or else that name."""
    folder = F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2)
    found = F.regexp_extract(folder, r"\d{4}-\d{2}-\d{2}_\d{2}\.\d{2}\.\d{2}", 0)
    return F.when(found != "", found).otherwise(folder)


def measurement_time(path: Column) -> Column:
    """measurement_id as a time stamp; null where the folder's name holds none."""
    return F.regexp_replace(F.regexp_replace(measurement_id(path), "_", " "), r"(\d{2})\.(\d{2})\.(\d{2})$", "$1:$2:$3").try_cast("timestamp_ntz")


def frame_name(frame: Column) -> Column:
    return F.concat(F.lit("frame_"), F.lpad(frame.cast("string"), 6, "0"))


def frame_number(name: Column) -> Column:
    return F.regexp_extract(name, r"frame_(\d+)", 1).try_cast("long")


def moment(day: Column, time: Column) -> Column:
    """A time stamp from the texts of a day and a time; null if they are none."""
    return F.concat_ws(" ", day, time).try_cast("timestamp_ntz")
