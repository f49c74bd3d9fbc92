"""Spectra as aggregates: sums of value * cos and value * sin per series and bin, restricted to a band."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source_id", "axis"]


def hann(kind: str, i: np.ndarray, n: int) -> np.ndarray:
    """Hann window: periodic (over n) or symmetric (over n - 1), or none."""
    return np.ones(len(i)) if kind == "none" else 0.5 - 0.5 * np.cos(2 * math.pi * i / (n if kind == "periodic" else max(n - 1, 1)))


def prepared(grid: DataFrame, keys: list[str] = KEYS, detrend: str = "mean") -> DataFrame:
    """Samples i = 0 .. n - 1 of each uniform series (k, value) without their mean or linear trend.

    One grouping and one join. Spark takes a resampled series for as small as the table it came from, so hints keep it, and spectra, from being broadcast.
    """
    line = [F.regr_slope("value", "k").alias("_s"), F.avg("k").alias("_c")] if detrend == "linear" else []
    whole = grid.groupBy(*keys).agg(F.count("*").alias("n"), F.min("k").alias("_k"), F.avg("value").alias("_m"), *line)
    x = F.col("value") - F.col("_m")
    if line:
        x = x - F.coalesce("_s", F.lit(0.0)) * (F.col("k") - F.col("_c"))
    return grid.join(whole.hint("merge"), keys).withColumns({"i": F.col("k") - F.col("_k"), "x": x}).drop("_k", "_m", "_s", "_c").hint("merge")


def spectrum(rows: DataFrame, step: float, low: float, high: float, kind: str = "periodic", keys: list[str] = KEYS, held: int = 1_000_000) -> DataFrame:
    """Single-sided amplitudes of the bins with low <= frequency <= high: bin, frequency, amplitude, power.

    The window's mean is divided out (where it is 0, as in a Hann window of one sample, amplitudes are NaN); bins other than 0 and the last of an even series (with the symmetric
    window, of any series) count twice. About `held` samples at a time give partial sums of their series' wanted bins where they are, by an FFT over the series' length with zeros
    for the samples that are elsewhere; these are summed up by bin. So the work grows as n log n;
    a task holds that many samples and a few times the length of its longest series.
    """
    kinds = dict(rows.dtypes)
    names = [*keys, "n"]

    def sums(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(len(table), np.int64)
        for c in names:
            one = table.column(c).combine_chunks().dictionary_encode("encode")
            code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(), return_inverse=True)[1].ravel()
        n, i, x = table.column("n").to_numpy(), table.column("i").to_numpy(), table.column("x").to_numpy()
        order = np.lexsort((code, n))
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        ends, lengths, at = np.append(starts[1:], len(order)), n[order[starts]], 0
        while at < len(starts):  # series of one length side by side, about `held` values at most
            size = int(lengths[at])
            stop = min(int(np.searchsorted(lengths, size, "right")), at + max(1, held // size))
            own = order[starts[at] : ends[stop - 1]]
            place = (np.repeat(np.arange(stop - at), ends[at:stop] - starts[at:stop]), i[own])
            weight = hann(kind, i[own], size)
            values = np.zeros((stop - at, size))
            values[place] = weight * x[own]
            first, last = math.ceil(low * size * step), min(size // 2, math.floor(high * size * step))
            if first <= last:
                found = np.fft.rfft(values)[:, first : last + 1]
                keep, bins = np.repeat(order[starts[at:stop]], found.shape[1]), np.tile(np.arange(first, last + 1), stop - at)
                whole = np.repeat(np.bincount(place[0], weight, stop - at), found.shape[1])
                columns = [table.column(c).combine_chunks().take(pa.array(keep)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (bins, found.real.ravel(), -found.imag.ravel(), whole))], names=[*names, "bin", "re", "im", "weight"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, count = [], 0
        for batch in batches:
            some.append(batch)
            count += len(batch)
            if count >= held:
                yield from sums(some)
                some, count = [], 0
        if count:
            yield from sums(some)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "bin long, re double, im double, weight double"])
    n = F.col("n")
    parts = rows.select(*names, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).where("x is not null").mapInArrow(run, schema)
    total = parts.groupBy(*names, "bin").agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight")])
    single = (F.col("bin") == 0) | ((F.col("bin") == F.floor(n / 2)) if kind == "symmetric" else (2 * F.col("bin") == n))
    amplitude = F.when(F.col("weight") != 0, F.hypot("re", "im") / F.col("weight") * F.when(single, 1.0).otherwise(2.0)).otherwise(F.lit(float("nan")))
    return total.select(*keys, "n", "bin", (F.col("bin") / (n * step)).alias("frequency"), amplitude.alias("amplitude"), (amplitude * amplitude).alias("power")).hint("merge")


def dominant(spectra: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Frequency of the largest amplitude without bin 0, ties to the lower one."""
    return spectra.where("bin > 0").groupBy(*keys).agg(F.max_by(F.struct("frequency", "amplitude"), F.struct(F.round("amplitude", 9), -F.col("bin"))).alias("_d")).select(*keys, "_d.*")


def dominant_bins(x: np.ndarray) -> np.ndarray:
    """As dominant with a periodic Hann window, of whole series of one length: x has a series a row; the bins."""
    n = x.shape[1]
    window = hann("periodic", np.arange(n), n)
    found = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window)[:, 1:])
    return 1 + np.round(found / window.sum() * np.where(2 * np.arange(1, n // 2 + 1) == n, 1.0, 2.0), 9).argmax(1)


def features(spectra: DataFrame, keys: list[str] = KEYS, *beside: Column) -> DataFrame:
    """Centroid and bandwidth by power, and how far the largest bin stands out from the median one; other aggregates of the bins above 0 `beside` them."""
    rows = spectra.where("bin > 0")
    p, f = F.col("power"), F.col("frequency")
    out = rows.groupBy(*keys).agg(F.sum(p).alias("_p"), F.sum(p * f).alias("_pf"), F.sum(p * f * f).alias("_pff"), F.max(p).alias("_top"), F.percentile(p, F.lit(0.5)).alias("_mid"), *beside)
    centroid = F.col("_pf") / F.col("_p")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_pff") / F.col("_p") - centroid * centroid))
    some = F.col("_p") > 0
    return out.select(*keys, F.when(some, centroid).alias("centroid"), F.when(some, spread).alias("bandwidth"), F.when(F.col("_mid") > 0, F.col("_top") / F.col("_mid")).alias("prominence"), *out.columns[len(keys) + 5 :])


def band(spectra: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    """Largest, mean and median amplitude in a band, and where the largest is."""
    rows = spectra.where(F.col("frequency").between(low, high))
    best = F.struct(F.round("amplitude", 9), -F.col("bin"))
    return rows.groupBy(*keys).agg(F.max("amplitude").alias("top"), F.max_by("frequency", best).alias("at"), F.avg("amplitude").alias("mean"), F.percentile("amplitude", F.lit(0.5)).alias("median"), F.count("*").alias("bins"))


def nearest(spectra: DataFrame, target: float, keys: list[str] = KEYS) -> DataFrame:
    distance = F.struct(F.round(F.abs(F.col("frequency") - target), 9), "bin")
    return spectra.groupBy(*keys).agg(F.min_by(F.struct("frequency", "amplitude"), distance).alias("_d")).select(*keys, "_d.*")


def peaks(spectra: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """The n largest bins that stand above their left and not below their right neighbour."""
    w = Window.partitionBy(*keys).orderBy("bin")
    rows = spectra.withColumns({"_a": F.lag("amplitude").over(w), "_b": F.lead("amplitude").over(w)}).where("amplitude > _a and amplitude >= _b")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("amplitude", 9)), "bin")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*keys, "rank", "frequency", "amplitude")


def harmonics(spectra: DataFrame, base: float, orders: int, width: float, nyquist: float, keys: list[str] = KEYS) -> DataFrame:
    """Of each whole multiple of base below the Nyquist frequency the strongest bin within width of it."""
    order = F.round(F.col("frequency") / base)
    rows = spectra.withColumn("harmonic", order.cast("int")).where(F.col("harmonic").between(1, orders) & (F.abs(F.col("frequency") - F.col("harmonic") * base) <= width) & (F.col("harmonic") * base <= nyquist))
    best = F.struct(F.round("amplitude", 9), -F.col("bin"))
    return rows.groupBy(*keys, "harmonic").agg(F.max_by(F.struct("frequency", "amplitude"), best).alias("_d")).select(*keys, "harmonic", "_d.*")


#: A power this small beside the uncentred one is rounding: the segment is flat.
FLAT = 1e-24


def welch(pairs: DataFrame, length: int, keys: list[str], together: int = 32) -> DataFrame:
    """Sums over the segments of each series of |A|^2, |B|^2, Re and Im of A B* by bin 1 .. length / 2: keys, bin, segments, aa, bb, re, im, ea, eb.

    Segments of `length` samples (k, a, b) overlap by half, start at the series' first k and are taken only where all samples are there; each is centred,
    given a periodic Hann window and transformed by an FFT. ea and eb are the uncentred powers. A task holds the samples of `together`
    segment starts and returns one row a bin, so neither samples nor segments are multiplied by bins.
    """
    step = length // 2
    size = together * step
    kinds = dict(pairs.dtypes)
    starts = pairs.groupBy(*keys).agg(F.min("k").alias("_k"))
    rows = pairs.join(starts, keys).select(*keys, (F.col("k") - F.col("_k")).cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in "ab"])
    rows = rows.where("a is not null and b is not null")
    window = hann("periodic", np.arange(length), length)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i = table.column("i").to_numpy() - key[-1].as_py() * size
        x = np.zeros((2, size + length))
        there = np.zeros(size + length, bool)
        there[i] = True
        x[0, i], x[1, i] = table.column("a").to_numpy(), table.column("b").to_numpy()
        full = np.cumsum(np.append(0, there))
        first = np.arange(0, size, step)
        first = first[full[first + length] - full[first] == length]
        cut = x[:, first[:, None] + np.arange(length)]
        a, b = np.fft.rfft((cut - cut.mean(2, keepdims=True)) * window)[:, :, 1:]
        cross = (a * b.conj()).sum(0)
        bins, n = a.shape[1], len(first)
        columns = {c: pa.repeat(v, bins) for c, v in zip(keys, key[:-1], strict=True)} | {"bin": pa.array(np.arange(1, bins + 1)), "segments": pa.array(np.full(bins, n))}
        energy = (cut**2).sum((1, 2))
        sums = {"aa": (abs(a) ** 2).sum(0), "bb": (abs(b) ** 2).sum(0), "re": cross.real, "im": cross.imag, "ea": np.full(bins, energy[0]), "eb": np.full(bins, energy[1])}
        return pa.table(columns | {c: pa.array(v, pa.float64()) for c, v in sums.items()}).slice(0, bins if n else 0)

    blocks = F.array_distinct(F.array(F.floor(F.col("i") / size), F.greatest(F.floor((F.col("i") - length + 1) / size), F.lit(0))))
    names = ["segments", "aa", "bb", "re", "im", "ea", "eb"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "bin long, segments long", *[f"{c} double" for c in names[1:]]])
    parts = rows.withColumn("_block", F.explode(blocks)).groupBy(*keys, "_block").applyInArrow(run, schema)
    return parts.groupBy(*keys, F.col("bin").cast("int").alias("bin")).agg(*[F.sum(c).alias(c) for c in names])


def coherence(pairs: DataFrame, length: int, step: float, keys: list[str]) -> DataFrame:
    """Power densities and magnitude-squared coherence of a and b, averaged over Hann-windowed, centred segments; flat sides have no power and no coherence."""
    sums = welch(pairs, length, keys)
    aa, bb = (F.when(F.col(p) > FLAT * length * F.col(e), F.col(p)).otherwise(0.0) for p, e in (("aa", "ea"), ("bb", "eb")))
    energy = length * 3 / 8  # of the squared periodic Hann window
    density = lambda p: p / F.col("segments") * step / energy * F.when(2 * F.col("bin") == length, 1.0).otherwise(2.0)
    return sums.select(*keys, "bin", "segments", (F.col("bin") / (length * step)).alias("frequency"), density(aa).alias("psd_a"), density(bb).alias("psd_b"), F.when((aa > 0) & (bb > 0), (F.col("re") ** 2 + F.col("im") ** 2) / (aa * bb)).alias("coherence"))


def coherence_summary(curve: DataFrame, target: float, near: float, low: float, high: float, keys: list[str]) -> DataFrame:
    """Coherence at the bin nearest to target, mean and largest within `near` of it, and mean, largest and bins of the band."""
    f, c = F.col("frequency"), F.col("coherence")
    around, inside = F.when(F.abs(f - target) <= near, c), F.when(f.between(low, high), c)
    return curve.groupBy(*keys).agg(
        F.min_by(c, F.struct(F.round(F.abs(f - target), 9), "bin")).alias("at_target"), F.avg(around).alias("near_mean"), F.max(around).alias("near_max"),
        F.avg(inside).alias("band_mean"), F.max(inside).alias("band_max"), F.count_if(f.between(low, high)).alias("band_bins"),
    )


def dominant_densities(curve: DataFrame, low: float, high: float, keys: list[str]) -> DataFrame:
    """Where a and b have their largest densities in the band and how far apart these are (also in percent of a's), and where the coherence is largest; ties to the lower bin."""
    f = F.col("frequency")
    at = lambda c: F.max_by(f, F.when(F.col(c).isNotNull(), F.struct(F.round(c, 9), -F.col("bin"))))
    top = lambda c: F.max(c)
    out = curve.where(f.between(low, high)).groupBy(*keys).agg(at("psd_a").alias("dominant_a"), top("psd_a").alias("density_a"), at("psd_b").alias("dominant_b"), top("psd_b").alias("density_b"), at("coherence").alias("coherent_at"))
    apart = F.abs(F.col("dominant_b") - F.col("dominant_a"))
    return out.withColumns({"difference": apart, "difference_percent": F.when(F.abs("dominant_a") > 1e-12, 100.0 * apart / F.abs("dominant_a"))})


def against_reference(found: DataFrame, reference: str, within: float) -> DataFrame:
    """Each harmonic of the reference axis beside that of every other axis of its source: error in percent, observable, preserved (within that error).

    One grouping by source, which has a few rows an axis, so the spectra are made once.
    """
    here = F.struct("axis", "harmonic", "amplitude")
    sides = found.groupBy("source_id").agg(F.collect_list(F.when(F.col("axis") == reference, here)).alias("_base"), F.collect_list(F.when(F.col("axis") != reference, here)).alias("_others"))
    pairs = sides.select("source_id", F.explode("_base").alias("_r"), "_others").select("source_id", "_r", F.explode(F.array_distinct(F.col("_others.axis"))).alias("axis"), "_others")
    same = F.filter("_others", lambda o: (o["axis"] == F.col("axis")) & (o["harmonic"] == F.col("_r.harmonic")))
    out = pairs.select("source_id", "axis", F.col("_r.harmonic").alias("harmonic"), F.col("_r.amplitude").alias("reference"), F.get(same, F.lit(0))["amplitude"].alias("amplitude"))
    error = 100.0 * F.abs(F.col("amplitude") - F.col("reference")) / F.col("reference")
    return out.withColumns({"error": error, "observable": F.col("amplitude").isNotNull(), "preserved": F.coalesce(error <= within, F.lit(False))})


def preserved(compared: DataFrame, keys: list[str]) -> DataFrame:
    """How many reference harmonics are observable and preserved, and their shares in percent."""
    out = compared.groupBy(*keys).agg(F.count("*").alias("harmonics"), F.count_if("observable").alias("observable"), F.count_if("preserved").alias("preserved"))
    return out.withColumns({f"{c}_percent": 100.0 * F.col(c) / F.col("harmonics") for c in ("observable", "preserved")})
