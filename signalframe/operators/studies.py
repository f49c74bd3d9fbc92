"""Smaller studies: regions, runtimes, damping, decimation, polygons, colours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.scalars import relative_error
from signalframe.operators.blocks import cumulative
from signalframe.operators.filtering import low_pass, mirrored_dot
from signalframe.operators.series import resampled
from signalframe.operators.spectral import dominant, dominant_bins, prepared, spectrum

KEYS = ["source_id", "axis"]


def by_region(vectors: DataFrame, regions: DataFrame, width: float = 100.0) -> DataFrame:
    """Of each frame and region (roi, x_from, x_to) the mean, median and largest motion of the vectors in it.

    Regions and vectors meet by strips of `width`, so any number of regions is an equi-join.
    """
    strip = lambda c: F.floor(c / width)
    cut = regions.where("x_from < x_to").withColumn("_strip", F.explode(F.sequence(strip(F.col("x_from")), strip(F.col("x_to")))))
    inside = (F.col("x") >= F.col("x_from")) & (F.col("x") < F.col("x_to"))
    rows = vectors.withColumn("_strip", strip(F.col("x"))).join(cut, "_strip").where(inside).withColumn("_m", F.hypot("dx", "dy"))
    return rows.groupBy("frame", "roi").agg(
        F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"), F.percentile("dx", F.lit(0.5)).alias("med_dx"), F.avg("_m").alias("mean_m"), F.percentile("_m", F.lit(0.5)).alias("med_m"), F.max("_m").alias("max_m"), F.count("*").alias("n")
    )


def accumulated(by_frame: DataFrame) -> DataFrame:
    """Cumulative mean motion of each region along its frames."""
    out = by_frame
    for c in ("dx", "dy"):
        out = cumulative(out, ["roi"], "frame", f"mean_{c}", f"cum_{c}")
    return out


def region_summary(by_frame: DataFrame) -> DataFrame:
    """Long table of half range, RMS and mean for each region and signal."""
    rows = by_frame.unpivot(["frame", "roi"], ["mean_dx", "mean_dy", "mean_m", "cum_dx", "cum_dy"], "signal", "value")
    v = F.col("value")
    return rows.groupBy("roi", "signal").agg(((F.max(v) - F.min(v)) / 2).alias("amplitude"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean"))


def runtimes(frames: DataFrame, seconds: str, keys: list[str]) -> DataFrame:
    """Mean, population deviation and rate of the run times."""
    return frames.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std"), F.when(F.avg(seconds) > 0, 1 / F.avg(seconds)).alias("fps"))


def damping(peaks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """From positive peaks in time: median period, damped frequency, median logarithmic decrement, damping ratio."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = peaks.where("value > 0").withColumns({"_t": F.lead("t").over(w), "_v": F.lead("value").over(w)}).where("_t is not null")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.col("_t") - F.col("t"), F.lit(0.5)).alias("period"), F.percentile(F.ln(F.col("value") / F.col("_v")), F.lit(0.5)).alias("decrement"))
    d = F.col("decrement")
    return out.withColumns({"frequency": F.when(F.col("period") > 0, 1 / F.col("period")), "ratio": d / F.sqrt(4 * F.pi() * F.pi() + d * d)})


def decay_ratio(envelopes: DataFrame, share: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Medians of the first and last share of samples (at least one) and their ratio."""
    n = F.col("_n")
    part = F.greatest(F.lit(1), F.ceil(n * share))
    rows = envelopes.join(envelopes.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    rows = rows.withColumns({"_a": F.col("idx") < part, "_b": F.col("idx") >= n - part})
    med = lambda c: F.percentile(F.when(F.col(c), F.col("value")), F.lit(0.5))
    out = rows.groupBy(*keys).agg(med("_a").alias("start"), med("_b").alias("end"))
    return out.withColumns({"ratio": F.when(F.col("start") != 0, F.col("end") / F.col("start")), "decaying": F.col("end") < F.col("start")})


def downsampled(signals: DataFrame, factors: list[int], keys: list[str] = KEYS) -> DataFrame:
    """Of each series and factor: samples kept, their rate and Nyquist frequency, and the amplitude (q95 - q05) / 2 against factor 1."""
    wide = signals.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).where("idx % factor = 0")
    out = wide.groupBy(*keys, "factor").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    out = out.withColumns({"rate": F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span")), "amplitude": (F.col("_q")[1] - F.col("_q")[0]) / 2}).drop("_q")
    reference = F.max(F.when(F.col("factor") == 1, F.col("amplitude"))).over(Window.partitionBy(*keys))
    return out.withColumns({"nyquist": F.col("rate") / 2, "kept_amplitude": F.when(reference > 0, 100 * F.col("amplitude") / reference)})


def downsampled_dominant(grid: DataFrame, factors: list[int], step: float, keys: list[str] = KEYS) -> DataFrame:
    """Of each series and factor that leaves three samples: rate, Nyquist frequency, resolution, dominant frequency and its distance from factor 1's."""
    names = [*keys, "factor"]
    rows = grid.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).where("k % factor = 0")
    rows = prepared(rows.withColumn("k", F.floor(F.col("k") / F.col("factor"))), names).where("n >= 3")
    found = dominant(spectrum(rows, 1.0, 0.0, 0.5, keys=names), names).join(rows.groupBy(*names).agg(F.first("n").alias("n")), names)
    rate = 1 / (step * F.col("factor"))
    found = found.select(*names, "n", rate.alias("rate"), (rate / 2).alias("nyquist"), (rate / F.col("n")).alias("resolution"), (F.col("frequency") * rate).alias("dominant"))
    reference = F.max(F.when(F.col("factor") == 1, F.col("dominant"))).over(Window.partitionBy(*keys))
    return found.withColumn("difference", F.col("dominant") - reference)


def anti_aliased(grid: DataFrame, factors: list[int], step: float, within: float, taps: int = 101, share: float = 0.9, keys: list[str] = KEYS, held: int = 1_000_000) -> DataFrame:
    """As downsampled_dominant, but filtered below share of the new Nyquist frequency before samples are left out, with the relative errors in percent of
    dominant frequency and amplitude ((q95 - q05) / 2) against factor 1, and whether each is at most `within`. Series k are dense, values not null.

    The samples are shuffled once. Sorted series go through Python many at a time and give one row a factor; a task holds about `held` samples and a few times
    the length of its longest series.
    """
    kinds = dict(grid.dtypes)
    filters = {f: np.array([1.0] if f == 1 else low_pass(taps, share / (2 * f))) for f in factors}

    def begins(table: pa.Table) -> np.ndarray:
        """The rows at which a series begins."""
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in keys:
            code = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def measured(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, starts = table.column("value").to_numpy(), begins(table)
        lengths = np.diff(np.append(starts, len(x)))
        for f, weights in filters.items():
            n = -(-lengths // f)
            first = np.cumsum(n) - n
            at = (np.arange(n.sum()) - np.repeat(first, n)) * f
            y = mirrored_dot(x, np.repeat(starts, n) + at, at, np.repeat(lengths - 1, n), weights)
            for size in np.unique(n[n >= 3]).tolist():
                alike = np.flatnonzero(n == size)
                for some in np.array_split(alike, min(len(alike), -(-len(alike) * size // held))):
                    values = y[first[some][:, None] + np.arange(size)]
                    frequency = dominant_bins(values) / size
                    values.sort(1)
                    columns = [table.column(c).combine_chunks().take(pa.array(starts[some])) for c in keys]
                    columns += [pa.array(np.full(len(some), f, np.int32)), pa.array(np.full(len(some), size)), pa.array(frequency), pa.array((quantile(values, 0.95) - quantile(values, 0.05)) / 2)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "factor", "n", "frequency", "amplitude"])

    def quantile(ordered: np.ndarray, q: float) -> np.ndarray:
        place = (ordered.shape[1] - 1) * q
        low, high = math.floor(place), math.ceil(place)
        return ordered[:, low] if low == high else (high - place) * ordered[:, low] + (place - low) * ordered[:, high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, count, enough = [], 0, held
        for batch in batches:
            some.append(batch)
            count += len(batch)
            if count >= enough:
                table = pa.Table.from_batches(some)
                last = int(begins(table)[-1])
                if last:
                    yield from measured(table.slice(0, last))
                some, count = table.slice(last).to_batches(), len(table) - last
                enough = max(held, 2 * count)  # a long series is not looked through again with each batch
        if count:
            yield from measured(pa.Table.from_batches(some))

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "factor int, n long, frequency double, amplitude double"])
    rows = grid.select(*keys, "k", F.col("value").cast("double").alias("value")).repartition(*keys).sortWithinPartitions(*keys, "k")
    period = step * F.col("factor")
    found = rows.select(*keys, "value").mapInArrow(run, schema).select(*keys, "factor", "n", (1 / period).alias("rate"), (F.col("frequency") / period).alias("dominant"), "amplitude")
    base = lambda c: F.max(F.when(F.col("factor") == 1, F.col(c))).over(Window.partitionBy(*keys))
    found = found.withColumns({"_f": base("dominant"), "_a": base("amplitude")}).withColumns({"frequency_error": relative_error(F.col("dominant"), F.col("_f")), "amplitude_error": relative_error(F.col("amplitude"), F.col("_a"))})
    return found.withColumns({"frequency_ok": F.coalesce(F.col("frequency_error") <= within, F.lit(False)), "amplitude_ok": F.coalesce(F.col("amplitude_error") <= within, F.lit(False)), "below_nyquist": F.coalesce(F.col("_f") < F.col("rate") / 2, F.lit(False))}).drop("_f", "_a")


#: Fixed names of the columns of a segmentation result that are signals.
SEGMENTATION = ("inner_pipe_center_y", "inner_pipe_center_x", "bed_edge_y", "bed_edge_y_smooth", "particle_bed_center_y", "particle_bed_center_x", "bed_center_y", "bed_center_x")


def signal_summary(rows: DataFrame, keys: list[str], order: str, columns: tuple[str, ...] = SEGMENTATION) -> DataFrame:
    """Of each recording and each signal column that rows has: half range and RMS against the first value, and the dominant frequency per frame.

    Gaps are bridged linearly for the frequency, which is null for a signal of fewer than three frames.
    """
    names = [*keys, "signal"]
    long = rows.unpivot([*keys, order], [c for c in columns if c in rows.columns], "signal", "value").where("value is not null")
    first = long.groupBy(*names).agg(F.min_by("value", order).alias("_first"))
    long = long.join(first, names).select(*names, F.col(order).cast("double").alias("t"), F.col(order).alias("idx"), (F.col("value") - F.col("_first")).alias("value"))
    v = F.col("value")
    size = long.groupBy(*names).agg(F.count("*").alias("n"), ((F.max(v) - F.min(v)) / 2).alias("amplitude"), F.sqrt(F.avg(v * v)).alias("rms"))
    spectra = spectrum(prepared(resampled(long, 1.0, names), names).where("n >= 3"), 1.0, 0.0, 0.5, keys=names)
    return size.join(dominant(spectra, names).select(*names, F.col("frequency").alias("dominant")), names, "left")


def edge_metrics(rows: DataFrame, keys: list[str], order: str, value: str, jump: float = 20.0) -> DataFrame:
    """Mean and population deviation of an edge, and its steps of more than `jump` between consecutive rows."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return rows.withColumn("_d", step).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count_if(F.col("_d") > jump).alias("jumps"))


def first_frame_gain(brightness: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Gain that brings each frame to the brightness of its series' first frame."""
    first = brightness.groupBy(*keys).agg(F.min_by(value, frame).alias("_first"))
    return brightness.join(first, keys).withColumn("gain", F.when(F.col(value) > 0, F.col("_first") / F.col(value)).otherwise(1.0)).drop("_first")


def polygon_area(xs: Column, ys: Column, width: int, height: int) -> Column:
    """Shoelace area of a polygon whose points are rounded and cut to the image; null under three points."""
    cut = lambda a, top: F.transform(a, lambda v: F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(float(top - 1))))
    x, y = cut(xs, width), cut(ys, height)
    following = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    cross = F.zip_with(F.zip_with(x, following(y), lambda a, b: a * b), F.zip_with(following(x), y, lambda a, b: a * b), lambda a, b: a - b)
    return F.when(F.size(xs) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Fixed luma weights 0.299, 0.587, 0.114."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def rescaled(mask: DataFrame, size: int, to: int) -> DataFrame:
    """Nearest-neighbour rescale of square masks (frame, y, x, on) from size to a size that divides it."""
    step = size // to
    return mask.where((F.col("y") % step == step // 2) & (F.col("x") % step == step // 2)).select("frame", F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x"), "on")


def tracking(tracks: DataFrame, jump: float) -> DataFrame:
    """One row: tracks, their mean length, steps longer than `jump` between consecutive positions, their share of all steps."""
    w = Window.partitionBy("track_id").orderBy("t", "object_id")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    each = tracks.withColumn("_s", step).groupBy("track_id").agg(F.count("*").alias("n"), F.count("_s").alias("steps"), F.count(F.when(F.col("_s") > jump, 1)).alias("jumps"))
    out = each.agg(F.count("*").alias("tracks"), F.avg("n").alias("mean_length"), F.sum("jumps").alias("jumps"), F.sum("steps").alias("_n"))
    return out.withColumn("jump_ratio", F.when(F.col("_n") > 0, F.col("jumps") / F.col("_n"))).drop("_n")


def tracks_per_frame(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: frames, mean and largest number of tracks in one (frames without any count as 0), observations."""
    each = tracks.groupBy("frame").agg(F.count_distinct("track_id").alias("n"), F.count("*").alias("o"))
    rows = frames.join(each, "frame", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("o", F.lit(0)).alias("o"))
    return rows.agg(F.count("*").alias("frames"), F.avg("n").alias("mean_tracks"), F.max("n").alias("most_tracks"), F.sum("o").alias("observations"))


#: Fixed patterns: the kind of quality measure that a metric's name stands for.
METRIC_KINDS = {"correlation": "corr|pearson|coherence", "error": "rmse|mae|error|std", "lag": "lag|shift", "coverage": "coverage|rate|share"}


def metric_kind(name: Column) -> Column:
    out = None
    for kind, pattern in METRIC_KINDS.items():
        test = F.lower(name).rlike(pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")
