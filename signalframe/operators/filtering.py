"""Digital filters of long series: fixed weights over neighbours, recursive ones in blocks with a warm-up."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.operators.blocks import with_halo


def dot(df: DataFrame, keys: list[str], index: str, value: str, weights: list[float], out: str, size: int = 100_000) -> DataFrame:
    """Centred dot product with an odd number of weights; null where a neighbour is missing."""
    half = len(weights) // 2
    w = Window.partitionBy(*keys, "block").orderBy(index)
    rows = with_halo(df, index, size, half, half)
    around = F.collect_list(value).over(w.rowsBetween(-half, half))
    total = F.aggregate(F.zip_with(around, F.array(*[F.lit(float(c)) for c in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("_around", around).withColumn(out, F.when(F.size("_around") == len(weights), total))
    return rows.where(~F.col("halo")).drop("block", "halo", "_around")


def weighted_sum(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def reflected(df: DataFrame, keys: list[str], index: str, value: str, weights: list[float], out: str, size: int = 100_000) -> DataFrame:
    """As dot, but at a series' ends the missing neighbours are those on the other side, mirrored at the end sample; null in series too short for that."""
    half = len(weights) // 2
    w = Window.partitionBy(*keys, "block").orderBy(index)
    rows = with_halo(df, index, size, half, half)
    rows = rows.withColumns({"_x": F.collect_list(value).over(w.rowsBetween(-half, half)), "_l": half - F.count(value).over(w.rowsBetween(-half, -1)), "_r": half - F.count(value).over(w.rowsBetween(1, half))})
    whole = F.expr("concat(reverse(slice(_x, 2, int(_l))), _x, reverse(slice(_x, int(size(_x) - _r), int(_r))))")
    rows = rows.withColumn(out, F.when(F.size("_x") > F.greatest("_l", "_r"), weighted_sum(whole, F.array(*[F.lit(float(c)) for c in weights]))))
    return rows.where(~F.col("halo")).drop("block", "halo", "_x", "_l", "_r")


def fitted(df: DataFrame, keys: list[str], index: str, value: str, window: int, degree: int, out: str, derivative: int = 0, step: float = 1.0, size: int = 100_000) -> DataFrame:
    """Savitzky-Golay filter: the least-squares polynomial of the `window` samples around each one, or its derivative.

    At a series' ends the polynomial of the first or last `window` samples is evaluated off its middle. Null in shorter series.
    """
    half = window // 2
    inverse = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))
    at = np.arange(-half, half + 1)
    powers = np.array([[math.perm(j, derivative) * float(o) ** (j - derivative) if j >= derivative else 0.0 for j in range(degree + 1)] for o in at])
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in powers @ inverse / step**derivative])
    w = Window.partitionBy(*keys, "block").orderBy(index)
    rows = with_halo(df, index, size, window - 1, window - 1)
    rows = rows.withColumns({"_x": F.collect_list(value).over(w.rowsBetween(1 - window, window - 1)), "_p": F.count(value).over(w.rowsBetween(1 - window, -1))})
    rows = rows.withColumn("_s", F.greatest(F.lit(1), F.least(F.col("_p") - half + 1, F.size("_x") - window + 1)).cast("int"))
    values, weights = F.slice("_x", F.col("_s"), F.lit(window)), F.element_at(table, (F.col("_p") + 2 - F.col("_s")).cast("int"))
    rows = rows.withColumn(out, F.when(F.size("_x") >= window, weighted_sum(values, weights)))
    return rows.where(~F.col("halo")).drop("block", "halo", "_x", "_p", "_s")


def savitzky_golay(window: int, degree: int, derivative: int = 0, step: float = 1.0) -> list[float]:
    """Weights of the middle sample of a least-squares polynomial over `window` samples, or of its derivative."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    return (np.linalg.pinv(powers)[derivative] * math.factorial(derivative) / step**derivative).tolist()


def mirrored_dot(x: np.ndarray, here: np.ndarray, at: np.ndarray, top: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Dot products around the samples x[here], which are number `at` of 0 .. top in their series (in order and without gaps in x).

    Neighbours beyond a series' ends are mirrored at the end sample as far as the series reaches, and 0 from there on.
    """
    out, half = np.zeros(len(here)), len(weights) // 2
    for o, w in zip(range(-half, half + 1), weights[::-1], strict=True):
        k = at + o
        k = np.where(k < 0, -k, np.where(k > top, 2 * top - k, k))
        there = (k >= 0) & (k <= top)
        out += np.where(there, x[np.where(there, here + k - at, 0)], 0.0) * w
    return out


def decimated_low_pass(df: DataFrame, keys: list[str], index: str, value: str, weights: list[float], factor: int, out: str, size: int = 100_000) -> DataFrame:
    """Every factor-th sample of the filtered series and no other: rows with index % factor = 0, index / factor as the new index, and `out`.

    Neighbours beyond a series' ends are mirrored at the end sample as far as the series reaches, and 0 from there on. Only the kept samples'
    dot products are computed, in blocks of `size` samples with half a filter before and after; the index is dense from 0.
    """
    half, h = len(weights) // 2, np.array(weights, np.float64)
    counts = df.groupBy(*keys).agg(F.max(index).alias("_top"))
    rows = with_halo(df.join(counts, keys), index, size, half, half)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {out} double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        x, at = table.column(value).to_numpy().astype(np.float64), table.column(index).to_numpy()
        own = ~table.column("halo").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(own & (at % factor == 0))
        y = mirrored_dot(x, keep, at[keep], table.column("_top")[0].as_py(), h)
        kept = table.take(pa.array(keep)).drop_columns(["block", "halo", "_top"])
        return kept.append_column(out, pa.array(y, pa.float64()))

    found = rows.groupBy(*keys, "block").applyInArrow(run, schema)
    return found.withColumn(index, F.floor(F.col(index) / factor))


def low_pass(taps: int, cutoff: float) -> list[float]:
    """Hamming-windowed sinc with the cutoff in cycles per sample; the weights sum to 1."""
    at = np.arange(taps) - (taps - 1) / 2
    weights = np.sinc(2 * cutoff * at) * np.hamming(taps)
    return (weights / weights.sum()).tolist()


def hilbert(taps: int) -> list[float]:
    """Hamming-windowed Hilbert transformer (odd number of taps)."""
    at = np.arange(taps) - taps // 2
    raw = np.where(at % 2 != 0, 2 / (np.pi * np.where(at == 0, 1, at)), 0.0)
    return (raw * np.hamming(taps))[::-1].tolist()


def envelope(df: DataFrame, keys: list[str], index: str, value: str, taps: int = 63, out: str = "envelope") -> DataFrame:
    """Length of the analytic signal by a finite Hilbert transformer: an approximation, null within taps // 2 of the ends."""
    rows = dot(df, keys, index, value, hilbert(taps), "_h")
    return rows.withColumn(out, F.hypot(value, "_h")).drop("_h")


def butterworth(order: int, low: float | None, high: float | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of up to second order of a low-pass (low None), high-pass (high None) or band-pass; cutoffs in cycles per sample.

    The poles of the prototype are mapped to the band and then to the unit circle; a band-pass has twice the order and gain 1
    at the band's middle. An odd order has a first-order section.
    """
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is None:
        poles, zeros, middle = math.tan(math.pi * high) * prototype, (-1, -1), 0.0
    elif high is None:
        poles, zeros, middle = math.tan(math.pi * low) / prototype, (1, 1), 0.5
    else:
        a, b = math.tan(math.pi * low), math.tan(math.pi * high)
        half = prototype * (b - a) / 2
        root = np.sqrt(half * half - a * b)
        poles, zeros, middle = np.concatenate([half + root, half - root]), (1, -1), math.atan(math.sqrt(a * b)) / math.pi
    poles = (1 + poles) / (1 - poles)
    real = np.sort(poles[np.abs(poles.imag) < 1e-12].real)
    pairs = [(p, p.conjugate()) for p in poles[poles.imag >= 1e-12]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    at, sections = np.exp(-2j * np.pi * middle), []
    for pair in pairs:
        num, den = (np.pad(np.real(np.poly(x)), (0, 2 - len(pair))) for x in (zeros[: len(pair)], pair))
        sections.append((num / abs(np.polyval(num[::-1], at) / np.polyval(den[::-1], at)), den))
    return sections


def run_sections(x: np.ndarray, sections, width: int = 64) -> np.ndarray:
    """The sections one after the other, `width` samples at a time: within a stretch by its response to input and state, from stretch to stretch by the state."""
    n = len(x)
    if not n:
        return x
    for b, a in sections:
        gain = b.sum() / a.sum() if abs(a.sum()) > 1e-12 else 0.0
        step, feed = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        powers = [np.eye(2)]
        for _ in range(width):
            powers.append(step @ powers[-1])
        response = np.array([b[0], *[(p @ feed)[0] for p in powers[: width - 1]]])
        lag = np.arange(width)[:, None] - np.arange(width)[None, :]
        inner = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        from_state = np.array([p[0] for p in powers[:width]])
        to_state = np.array([powers[width - 1 - j] @ feed for j in range(width)])
        rows = np.pad(x, (0, -n % width)).reshape(-1, width)
        pushed = rows @ to_state
        states = np.empty((len(rows), 2))
        state = np.array([x[0] * (gain - b[0]), x[0] * (b[2] - a[2] * gain)])  # the steady state of the first sample
        for i in range(len(rows)):
            states[i] = state
            state = powers[width] @ state + pushed[i]
        x = (rows @ inner.T + states @ from_state.T).ravel()[:n]
    return x


def zero_phase(x: np.ndarray, sections) -> np.ndarray:
    return run_sections(run_sections(x, sections)[::-1], sections)[::-1]


def warm_up(sections, epsilon: float = 1e-8) -> int:
    """Samples after which the slowest pole has decayed to epsilon."""
    radius = max(abs(np.roots(a)).max() for _, a in sections)
    return int(math.ceil(math.log(epsilon) / math.log(min(radius, 0.999999))))


def filtered(df: DataFrame, keys: list[str], index: str, value: str, order: int, low: float | None, high: float | None, out: str = "filtered", size: int = 50_000) -> DataFrame:
    """Zero-phase Butterworth filter. Each block of a series runs forward and backward with a warm-up halo on both sides.

    Within a block the result differs from that over the whole series by the chosen decay of the slowest pole (1e-8).
    At a series' true ends the filter starts from the first or last sample's steady state.
    """
    sections = butterworth(order, low, high)
    halo = warm_up(sections)
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + f", {out} double"
    rows = with_halo(df, index, size, halo, halo)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        x = table.column(value).to_numpy().astype(np.float64)
        y = zero_phase(x, sections)
        keep = pa.compute.invert(table.column("halo"))
        return table.append_column(out, pa.array(y)).filter(keep).drop_columns(["block", "halo"])

    return rows.groupBy(*keys, "block").applyInArrow(run, schema)


def prominent_peaks(df: DataFrame, keys: list[str], index: str, value: str, prominence: float, reach: int, distance: int, size: int = 100_000) -> DataFrame:
    """Local maxima that stand out by `prominence` over the higher of the lowest values on both sides, within `reach` samples.

    Sides end at a higher sample. Of peaks nearer than `distance` the higher one stays (ties to the earlier): a peak goes
    if a higher prominent peak is that near.
    """
    w = Window.partitionBy(*keys, "block").orderBy(index)
    rows = with_halo(df, index, size, reach, reach)
    rows = rows.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w), "_l": F.reverse(F.collect_list(value).over(w.rowsBetween(-reach, -1))), "_r": F.collect_list(value).over(w.rowsBetween(1, reach))})
    rows = rows.where(~F.col("halo")).drop("block", "halo")
    rows = rows.where((F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b")))

    def base(side: str):
        low = F.aggregate(
            side, F.struct(F.col(value).alias("low"), F.lit(True).alias("open")),
            lambda s, v: F.when(s["open"] & (v <= F.col(value)), F.struct(F.least(s["low"], v).alias("low"), F.lit(True).alias("open"))).otherwise(F.struct(s["low"].alias("low"), F.lit(False).alias("open"))),
        )
        return low["low"]

    rows = rows.withColumn("prominence", F.col(value) - F.greatest(base("_l"), base("_r"))).where(F.col("prominence") >= prominence).drop("_a", "_b", "_l", "_r")
    near = Window.partitionBy(*keys, "block").orderBy(index).rangeBetween(-(distance - 1), distance - 1)
    best = F.max(F.struct(F.col(value), -F.col(index))).over(near)
    rows = with_halo(rows, index, size, distance - 1, distance - 1).withColumn("_best", -best["col2"])
    return rows.where((F.col("_best") == F.col(index)) & ~F.col("halo")).drop("_best", "block", "halo")
