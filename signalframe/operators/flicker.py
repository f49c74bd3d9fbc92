"""Flicker of a brightness series: the part of its latest values near one frequency, and the gain that takes it out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.operators.blocks import exponential_mean, with_halo


def flicker_bins(n: int, frequency: float, second: bool = False) -> dict[int, float]:
    """Weights of the spectral bins of n values that make the flicker: the bin nearest to the frequency (cycles per value; the lower of two) and half
    of its neighbours; with `second` also half of the bin nearest to twice the frequency and a quarter of its neighbours, in place of the first where they meet."""
    freqs = np.arange(n // 2 + 1) / n
    out: dict[int, float] = {}
    for f, w in [(frequency, 1.0)] + [(2 * frequency, 0.5)] * second:
        mid = int(np.argmin(np.round(np.abs(freqs - f), 12)))
        if mid > 0:
            out |= {k: w * (1.0 if k == mid else 0.5) for k in (mid, mid - 1, mid + 1) if k < len(freqs)}
    return out


def flicker_weights(n: int, frequency: float, second: bool = False) -> np.ndarray | None:
    """Weights of n values, oldest first, whose sum is the flicker at the newest one; they sum to 0. None without a bin."""
    bins, back = flicker_bins(n, frequency, second), n - 1 - np.arange(n)
    parts = [w * (1.0 if 2 * k == n else 2.0) / n * np.cos(2 * np.pi * (k * back % n) / n) for k, w in bins.items() if k]
    return np.sum(parts, axis=0) if parts else None


def newest_part(history: np.ndarray, frequency: float, second: bool = False) -> float | None:
    """The flicker at the newest of the values; None without a bin."""
    weights = flicker_weights(len(history), frequency, second)
    return None if weights is None else float((history - history.mean()) @ weights)


def flicker_gain(df: DataFrame, keys: list[str], index: str, value: str, frequency: float, n: int = 256, second: bool = False, alpha: float = 0.2, least: int = 32, size: int = 50_000) -> DataFrame:
    """Add flicker, target and gain to the brightness values of each series (index dense from 0, values not null).

    Flicker is the part of the last n values near the frequency, from `least` values on (null before). The target is the first brightness
    less the flicker, smoothed by an exponential mean that starts at the first brightness; gain is target / value, 1 for the first value and for
    values under 1e-6. Blocks of `size` values with n - 1 before them give the flicker; once n values are there it is one fixed set of weights. The mean runs
    in blocks too.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", flicker double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        x, at = table.column(value).to_numpy().astype(np.float64), table.column(index).to_numpy()
        out, there = np.zeros(len(x)), at + 1 >= max(least, 2)
        full = flicker_weights(n, frequency, second)
        if full is not None and len(x) >= n:
            middle = x.mean()
            out[n - 1 :] = np.convolve(x - middle, full[::-1], "valid")
        elif full is None:
            there &= at + 1 < n
        for i in np.flatnonzero(there & (at + 1 < n)).tolist():
            part = newest_part(x[i - at[i] : i + 1], frequency, second)
            out[i], there[i] = part or 0.0, part is not None
        return table.append_column("flicker", pa.array(out, mask=~there)).filter(pa.compute.invert(table.column("halo"))).drop_columns(["block", "halo"])

    rows = with_halo(df, index, size, n - 1, 0).groupBy(*keys, "block").applyInArrow(run, schema)
    first = df.where(F.col(index) == 0).select(*keys, F.col(value).cast("double").alias("_first"))
    rows = rows.join(first, keys).withColumn("_steady", F.col("_first") - F.coalesce("flicker", F.lit(0.0)))
    begin = max(1, least - 1)
    later = exponential_mean(rows.where(F.col(index) >= begin), keys, index, "_steady", alpha, "target", size, F.col("_first"))
    every = rows.where(F.col(index) < begin).withColumn("target", F.col("_first")).unionByName(later)
    gain = F.when((F.col(index) > 0) & (F.col(value) >= 1e-6), F.col("target") / F.col(value)).otherwise(F.lit(1.0))
    return every.withColumn("gain", gain).drop("_first", "_steady")
