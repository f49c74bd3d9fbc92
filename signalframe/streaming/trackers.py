"""Keyed state in frame order: trackers and running filters, for tables and for streams with the same functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import hypot

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalframe.operators.blocks import with_halo
from signalframe.operators.flicker import newest_part
from signalframe.sources.scratch import dropped, kept

@dataclass(slots=True)
class Kalman:
    """Constant-velocity filter of one object's centre; fixed covariances 10, 5 and 0.01.

    Both axes see the same noise and meet in no matrix, so they share one covariance of place and speed: p, c and q.
    """

    x: float
    y: float
    vx: float = 0.0
    vy: float = 0.0
    p: float = 10.0
    c: float = 0.0
    q: float = 10.0

    def predict(self) -> None:
        self.x += self.vx
        self.y += self.vy
        self.p += 2 * self.c + self.q + 0.01
        self.c += self.q
        self.q += 0.01

    def update(self, x: float, y: float) -> None:
        place, speed = self.p / (self.p + 5.0), self.c / (self.p + 5.0)
        dx, dy = x - self.x, y - self.y
        self.x += place * dx
        self.y += place * dy
        self.vx += speed * dx
        self.vy += speed * dy
        self.p, self.c, self.q = (1 - place) * self.p, (1 - place) * self.c, self.q - speed * self.c

    def numbers(self) -> list[float]:
        return [self.x, self.y, self.vx, self.vy, self.p, self.c, self.q]


@dataclass
class Single:
    """Follows the largest detection; coasts for up to `coast` frames without one, then gives no output until the next, which updates the same filter."""

    coast: int = 10
    filter: Kalman | None = None
    missed: int = 0

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> list[tuple]:
        best = np.lexsort((y, x, -area))[0] if len(x) else None
        if self.filter is None:
            if best is None:
                return []
            self.filter = Kalman(float(x[best]), float(y[best]))
        else:
            self.filter.predict()
            if best is not None:
                self.filter.update(float(x[best]), float(y[best]))
        self.missed = 0 if best is not None else self.missed + 1
        return [] if self.missed > self.coast else [(frame, 1, self.filter.x, self.filter.y, self.missed)]

    def numbers(self) -> list[float]:
        return [] if self.filter is None else [*self.filter.numbers(), self.missed]


@dataclass
class Multi:
    """Several objects: each track, oldest first, takes the nearest free detection nearer than `reach`; tracks end after `age` missed frames."""

    reach: float = 60.0
    age: int = 5
    next_id: int = 1
    tracks: list = field(default_factory=list)  # (id, Kalman, missed)

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> list[tuple]:
        order = np.lexsort((area, y, x))
        free = list(zip(x[order].tolist(), y[order].tolist(), strict=True))
        alive = []
        for ident, kalman, missed in self.tracks:
            kalman.predict()
            at_x, at_y, k, nearest = kalman.x, kalman.y, -1, self.reach
            for i, (px, py) in enumerate(free):
                distance = hypot(px - at_x, py - at_y)
                if distance < nearest:
                    k, nearest = i, distance
            if k >= 0:
                kalman.update(*free.pop(k))
                missed = 0
            else:
                missed += 1
            if missed <= self.age:
                alive.append((ident, kalman, missed))
        for px, py in free:
            alive.append((self.next_id, Kalman(px, py), 0))
            self.next_id += 1
        self.tracks = alive
        return [(frame, i, k.x, k.y, m) for i, k, m in alive]

    def numbers(self) -> list[float]:
        return [n for _, k, m in self.tracks for n in (*k.numbers(), m)]

    def handed_over(self) -> None:
        """Tracks alive so far are -1, -2, .. in their order; new ones count from 1."""
        self.tracks = [(-i, k, m) for i, (_, k, m) in enumerate(self.tracks, 1)]
        self.next_id = 1

    def alive(self) -> list[int]:
        return [i for i, _, _ in self.tracks]


@dataclass
class Smoother:
    """Median of the last `n` values, then an exponential mean."""

    n: int = 5
    alpha: float = 0.2
    last: list = field(default_factory=list)
    mean: float | None = None

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> list[tuple]:
        for value in x.tolist():
            self.last = [*self.last, value][-self.n :]
            median = float(np.median(self.last))
            self.mean = median if self.mean is None else (1 - self.alpha) * self.mean + self.alpha * median
        return [] if self.mean is None else [(frame, 1, self.mean, None, 0)]

    def numbers(self) -> list[float]:
        return [] if self.mean is None else [*self.last, self.mean]


@dataclass
class Deflicker:
    """Gain against flicker: the part of the last `n` brightness values near one frequency is taken from the first brightness, the target is smoothed.

    The part is that of the spectral bin nearest to the frequency and half of its neighbours, with `second` also half of the bin nearest
    to twice the frequency and a quarter of its neighbours, at the newest value. Until `least` values are there the target stays.
    """

    n: int = 256
    frequency: float = 0.25  # cycles per frame
    alpha: float = 0.2
    least: int = 32
    second: bool = False
    history: list = field(default_factory=list)
    first: float | None = None
    target: float | None = None

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> list[tuple]:
        out = []
        for value in x.tolist():
            self.history = [*self.history, value][-self.n :]
            if self.first is None:
                self.first = self.target = value
                out.append((frame, 1, 1.0, None, 0))
                continue
            flicker, target = None, self.first
            if len(self.history) >= self.least:
                flicker = newest_part(np.array(self.history), self.frequency, self.second)
                self.target = self.alpha * (self.first - (flicker or 0.0)) + (1 - self.alpha) * self.target
                target = self.target
            out.append((frame, 1, target / value if value >= 1e-6 else 1.0, flicker, 0))
        return out

    def numbers(self) -> list[float]:
        return [] if self.first is None else [*self.history, self.first, self.target]


SCHEMA = "frame long, track_id long, x double, y double, missed long"


def advanced(machine, frame: np.ndarray, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> list[tuple]:
    """Run rows in frame order through the machine; frames without a detection are rows without x."""
    out: list[tuple] = []
    order = np.argsort(frame, kind="stable")
    frame, x, y, area = frame[order], x[order], y[order], area[order]
    there = ~np.isnan(x)
    frames, first = np.unique(frame, return_index=True)
    for f, a, b in zip(frames.tolist(), first.tolist(), np.append(first, len(frame))[1:].tolist(), strict=True):
        on = there[a:b]
        out += machine.step(f, x[a:b][on], y[a:b][on], area[a:b][on])
    return out


def advance(machine, rows: pd.DataFrame) -> pd.DataFrame:
    """advanced() for a pandas frame with columns frame, x, y, area."""
    out = advanced(machine, rows["frame"].to_numpy(np.int64), *[rows[c].to_numpy(np.float64, na_value=np.nan) for c in ("x", "y", "area")])
    return pd.DataFrame(out, columns=["frame", "track_id", "x", "y", "missed"])


def keyed_schema(df: DataFrame, keys: list[str], rest: str = SCHEMA) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], rest])


def same_key(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns of two tables, nulls being equal."""
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[c])
    return out


CHUNK, WARM_UP = 10_000, 512


def track(detections: DataFrame, keys: list[str], machine: Callable[[], object], chunk: int = CHUNK, warm_up: int = WARM_UP, tolerance: float = 1e-12) -> DataFrame:
    """Tracks of each key over its whole recording: keys, frame, track_id, x, y, missed. Frames count from 0; detections: frame, x, y, area.

    A recording is cut into chunks of frames, which run side by side, each from a guess of its first state: that of an empty machine after
    the warm_up frames before the chunk. A guess that is not the state in which the chunk before ended (all numbers within
    the tolerance, relative beyond 1) is replaced by that state and its chunk runs again, until all guesses hold; the first wrong one
    of a recording is right after its turn, so the result does not depend on the chunks. A task holds the rows of one chunk and
    its warm-up. Tracks alive at a chunk's start get the number they had at the end of the one before, new ones the next numbers in order;
    these numbers come from the tracks at the borders alone, one small row a chunk.

    Every round is written to the shared folder. Machines that need more than warm_up frames to forget take more rounds, one a chunk at worst.
    """
    spark = detections.sparkSession
    names = [*keys, "block"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number, as few bytes here are much work
    rows = detections.select(*keys, F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area")]).where("frame >= 0")
    schema = keyed_schema(rows, keys, f"block long, {SCHEMA}, births long, alive array<long>, start binary, finish binary")

    def arrays(table: pa.Table) -> list[np.ndarray]:
        return [table.column("frame").to_numpy(), *[table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y", "area")]]

    def run(key: tuple, own, state: object) -> pa.Table:
        if hasattr(state, "handed_over"):
            state.handed_over()
        start = pickle.dumps(state)
        out = advanced(state, *own)
        n = len(out) + 1
        alive = state.alive() if hasattr(state, "alive") else []
        births = state.next_id - 1 if hasattr(state, "next_id") else 0
        columns = [[*c, None] for c in zip(*out, strict=True)] if out else [[None]] * 5
        none = [None] * (n - 1)
        table = {k: pa.repeat(v, n) for k, v in zip(names, key, strict=True)}
        table |= {c: pa.array(v, t) for c, v, t in zip(("frame", "track_id", "x", "y", "missed"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)}
        return pa.table(table | {"births": pa.array([*none, births], pa.int64()), "alive": pa.array([*none, alive], pa.list_(pa.int64())), "start": pa.array([*none, start], pa.binary()), "finish": pa.array([*none, pickle.dumps(state)], pa.binary())})

    def guess(key: tuple, table: pa.Table) -> pa.Table:
        halo = table.column("halo").to_numpy(zero_copy_only=False)
        state = machine()
        every = arrays(table)
        if halo.all():
            return run(key, [c[:0] for c in every], state).slice(0, 0)
        advanced(state, *[c[halo] for c in every])
        return run(key, [c[~halo] for c in every], state)

    def again(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, arrays(left), pickle.loads(right.column("before")[0].as_py()))

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = []
            for start, before in zip(batch.column("start").to_pylist(), batch.column("before").to_pylist(), strict=True):
                a, b = pickle.loads(start).numbers(), (pickle.loads(before) if before else machine()).numbers()
                off.append(len(a) != len(b) or not np.allclose(a, b, tolerance, tolerance))
            yield batch.filter(pa.array(off, pa.bool_())).select([*names, "before"])

    halved = with_halo(rows, "frame", chunk, warm_up, 0)
    found = kept(halved.repartition(parts, *names).groupBy(*names).applyInArrow(guess, schema))
    while True:
        states = found.where("frame is null").select(*names, "start", F.lag("finish").over(Window.partitionBy(*keys).orderBy("block")).alias("before"))
        off = kept(states.mapInArrow(wrong, keyed_schema(rows, keys, "block long, before binary")))
        if off.isEmpty():
            dropped(off)
            break
        own = rows.withColumn("block", F.floor(F.col("frame") / chunk))
        own = own.join(off, same_key(own, off, names), "left_semi").repartition(parts, *names)
        new = own.groupBy(*names).cogroup(off.repartition(parts, *names).groupBy(*names)).applyInArrow(again, schema)
        old = found
        found = kept(old.join(off, same_key(old, off, names), "left_anti").unionByName(new))
        dropped(old, off)
    tracks = found.where("frame is not null").select(*names, "frame", "track_id", "x", "y", "missed")
    if not hasattr(machine(), "handed_over"):
        return tracks.drop("block")

    def numbered(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        total, held, bases, ids = 0, [], [], []
        for births, alive in zip(table.column("births").to_pylist(), table.column("alive").to_pylist(), strict=True):
            bases.append(total)
            ids.append(held)
            held = [total + i if i > 0 else held[-i - 1] for i in alive]
            total += births
        return table.drop_columns(["births", "alive"]).append_column("base", pa.array(bases, pa.int64())).append_column("ids", pa.array(ids, pa.list_(pa.int64())))

    borders = found.where("frame is null").select(*names, "births", "alive").groupBy(*keys).applyInArrow(numbered, keyed_schema(rows, keys, "block long, base long, ids array<long>"))
    on = same_key(tracks, borders, names)
    ident = F.when(F.col("track_id") > 0, F.col("base") + F.col("track_id")).otherwise(F.get("ids", (-F.col("track_id") - 1).cast("int")))
    return tracks.join(borders, on).select(*[tracks[k] for k in keys], "frame", ident.alias("track_id"), "x", "y", "missed")


def track_stream(detections: DataFrame, keys: list[str], machine: Callable[[], object], idle_ms: int = 600_000) -> DataFrame:
    """The same over a stream whose batches arrive in frame order; a key without data for idle_ms is forgotten."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pickle.loads(state.get[0]) if state.exists else machine()
        out = advance(own, pd.concat(list(parts)))
        state.update((pickle.dumps(own),))
        state.setTimeoutDuration(idle_ms)
        for name, value in reversed(list(zip(keys, key, strict=True))):
            out.insert(0, name, value)
        yield out

    return detections.groupBy(*keys).applyInPandasWithState(run, keyed_schema(detections, keys), "machine binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_metrics(frames: DataFrame) -> DataFrame:
    """Of each run so far: frames, mean seconds, frames a second, most tracks. For update mode or a table."""
    return frames.groupBy("run_id").agg(F.count("*").alias("frames"), F.avg("seconds").alias("mean_seconds"), F.when(F.avg("seconds") > 0, 1 / F.avg("seconds")).alias("fps"), F.max("tracks").alias("most_tracks"))


def sliding_segments(signals: DataFrame, length: str = "10.24 seconds", step: str = "5.12 seconds", late: str = "30 seconds") -> DataFrame:
    """Statistics of half-overlapping segments of a live signal; samples later than `late` are dropped by the watermark."""
    rows = signals.withWatermark("ts", late) if signals.isStreaming else signals
    return rows.groupBy("source_id", F.window("ts", length, step)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).select("source_id", F.col("window.start").alias("start"), "n", "mean", "std")
