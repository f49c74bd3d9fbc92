"""Mixing sources to target weights by Pfair scheduling with exact rational weights."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import fresh, materialize, ranked

#: Stated target weights of op8_mixing and of the pipeline's stage; any other source gets their mean.
TARGETS = {"src0": 5, "src1": 2, "src2": 3.5}


class Schedule:
    """Earliest deadline first over the exact windows of all blocks.

    If slots could be shared, at virtual time v a source would have run min(blocks, weight * v) blocks, and v and the slots
    passed would fix each other: slots = sum of these over the sources. Source s would have run i blocks at the rational
    time(s, i). Its block i (from 0) is released at the floor of time(s, i) and due by the ceiling of time(s, i + 1).
    No span of slots holds more whole windows than slots, so earliest deadline first keeps every window and leaves no gap.
    So after every slot each source has run less than one block more or less than its share, also once others have ended.
    """

    def __init__(self, blocks: list[int], weights: list[int]):
        self.blocks, self.weights = blocks, weights
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
        # Phase p lasts until the source order[p] ends: blocks of the sources ended before it, weight of the others.
        self.ends, self.base, self.rate = [(blocks[s], weights[s]) for s in order], [], []
        base, rate = 0, sum(weights)
        for s in order:
            self.base.append(base)
            self.rate.append(rate)
            base, rate = base + blocks[s], rate - weights[s]

    def phase(self, s: int, i: int, low: int = 0) -> int:
        """The first phase from low on that lasts until source s has its share of i blocks."""
        w, ends = self.weights[s], self.ends
        if i * ends[low][1] <= ends[low][0] * w:
            return low
        return bisect_left(range(len(ends)), True, lo=low + 1, key=lambda p: i * ends[p][1] <= ends[p][0] * w)

    def walk(self, done: list[int], slot: int, until: int) -> Iterator[int]:
        """The source of each slot from slot to before until; done, the blocks run by each source, is carried on."""
        base, rate, weights = self.base, self.rate, self.weights
        later: list[tuple] = []
        ready: list[tuple] = []
        phases = [0] * len(done)

        def push(s: int) -> None:
            i, w = done[s], weights[s]
            if i < self.blocks[s]:
                p = self.phase(s, i, phases[s])
                q = phases[s] = self.phase(s, i + 1, p)
                heapq.heappush(later, (base[p] + rate[p] * i // w, base[q] - (-rate[q] * (i + 1) // w), s))

        for s in range(len(done)):
            push(s)
        for now in range(slot, until):
            while later and later[0][0] <= now:
                _, due, s = heapq.heappop(later)
                heapq.heappush(ready, (due, s))
            s = heapq.heappop(ready)[1]
            done[s] += 1
            push(s)
            yield s

    def periods(self, done: list[int], slot: int, span: int) -> tuple[int, list[int]]:
        """How many whole periods follow in which the schedule repeats itself, and the blocks of each source in one.

        Within a phase the windows repeat after the least number of slots in which every share is whole. If the same
        sources are ahead before and after one such period, the schedule repeats too, until windows reach the phase's end.
        """
        left = [s for s in range(len(done)) if done[s] < self.blocks[s]]
        unit = gcd(*[self.weights[s] for s in left])
        each = [0] * len(done)
        for s in left:
            each[s] = self.weights[s] // unit
        first = {self.phase(s, done[s]) for s in left}
        p = max(first)
        end, weight = self.ends[p]
        fit = min((end * self.weights[s] // weight - done[s] - 2) // each[s] for s in left)
        if sum(each) > span or len(first) > 1 or fit < 2:
            return 0, each
        after = list(done)
        for _ in self.walk(after, slot, slot + sum(each)):
            pass
        return (fit if all(a == d + e for a, d, e in zip(after, done, each, strict=True)) else 0), each

    def pieces(self, span: int) -> list[tuple]:
        """The schedule in pieces of at most span slots: first slot, repeats, and of each slot its source, block and blocks of that source in a repeat."""
        out, slot, done, total = [], 0, [0] * len(self.blocks), sum(self.blocks)
        while slot < total:
            repeats, each = self.periods(done, slot, span)
            size = sum(each) if repeats else min(span, total - slot)
            after, who, block = list(done), [], []
            for s in self.walk(after, slot, slot + size):
                who.append(s)
                block.append(after[s] - 1)
            if not repeats:
                out.append((slot, 1, who, block, [0] * size))
                slot, done = slot + size, after
            step = [each[s] for s in who]
            while repeats:
                n = min(repeats, span // size)
                out.append((slot, n, who, block, step))
                repeats, slot, done = repeats - n, slot + n * size, [d + n * e for d, e in zip(done, each, strict=True)]
                block = [b + n * e for b, e in zip(block, step, strict=True)]
        return out


def whole(weights: Mapping) -> dict:
    """The weights as whole numbers in exactly the same proportions; floats count as the decimals they print as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * unit) for s, w in exact.items()}


def mix(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 32, span: int = 4096, rows_per_group: int = 10_000) -> DataFrame:
    """One row per row of docs: doc_id, source, block, slot, position; ordered by position, the sources mix to their weights.

    The rows of a source, in a random order that depends on their ids only, form blocks of block_rows (the last may be shorter).
    Pfair scheduling runs one block a slot (see Schedule). After every slot, however many, a source has run less than one
    block more or less than its exact share; when a source ends, the others go on with their weights scaled up.
    No row is dropped or repeated. position is the slot times block_rows plus the row's place in the block.

    weights: positive target weights by source; sources that it lacks, a null source among them, get the mean weight,
    and without weights all are equal. Repeated rows are rows of their own; a null id is an id like others; empty input gives no rows.
    Only the sources' names and counts, one small row each, come to the driver. It hands out the schedule in pieces of at
    most span slots: one period for as many repeats as fit, or, where none of up to span slots repeats, every slot. Blocks are joined by source and number.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source")).withColumn("_row", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    if not sizes:
        return rows.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")])
    given = {k: Fraction(str(v)) for k, v in (weights or {}).items() if k in sizes and v > 0}
    mean = sum(given.values()) / len(given) if given else Fraction(1)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = whole({s: given.get(s, mean) for s in names})
    plan = Schedule([-(-sizes[s] // block_rows) for s in names], [target[s] for s in names])

    pieces = [(first, n, [names[s] for s in who], block, step) for first, n, who, block, step in plan.pieces(span)]
    slots = spark.createDataFrame(pieces, "first long, repeats int, who array<string>, block array<long>, step array<long>", verifySchema=False)
    slots = slots.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    slots = slots.select("first", "repeat", F.size("who").alias("size"), F.posexplode(F.arrays_zip("who", "block", "step")).alias("at", "of"))
    slots = slots.select(F.col("of.who").alias("name"), (F.col("of.block") + F.col("repeat") * F.col("of.step")).alias("at_block"), (F.col("first") + F.col("repeat") * F.col("size") + F.col("at")).alias("slot"))
    spread = F.when(F.col("doc_id").isNull(), F.col("_row")).otherwise(F.xxhash64("doc_id"))
    placed = ranked(rows, ["source"], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_row")], spread, rows_per_group, "rank", sum(sizes.values()))
    placed = placed.withColumns({"block": F.floor(F.col("rank") / block_rows), "in_block": F.col("rank") % block_rows})
    out = placed.join(slots, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("at_block")))
    return out.select("doc_id", "source", "block", "slot", (F.col("slot") * block_rows + F.col("in_block")).alias("position"))


def positions(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """_id and _position, one row per id; rows that repeat an id share its least position."""
    return mix(docs, weights, id_col, source_col).groupBy("doc_id").agg(F.min("position").alias("_position")).withColumnRenamed("doc_id", "_id")


def mixed(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, in mixed order. Ids must be unique; rows that repeat one share its place."""
    of, place = fresh(docs, "of"), fresh(docs, "place")
    at = positions(docs, weights, id_col, source_col).select(F.col("_id").alias(of), F.col("_position").alias(place))
    return docs.join(at, F.col(id_col).eqNullSafe(F.col(of))).orderBy(place, id_col).select(*[F.col(f"`{c}`") for c in docs.columns])
