"""Maximal repetitions of words by recompression: a run-length grammar answers how far two places of a text agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import WORD

LEAST_WORDS = 12


class Level(NamedTuple):
    """A text of symbols and how it is cut into the units that are the symbols of the next level."""

    symbols: np.ndarray
    left: np.ndarray | None  # of pair levels: whether a symbol opens pairs; None where units are blocks of one symbol
    unit: np.ndarray  # the unit of each place
    first: np.ndarray  # the first place of each unit, and the end


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's number by first occurrence, and how many keys differ."""
    encoded = pa.array(keys).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)


def cut(symbols: np.ndarray, begins: np.ndarray, left: np.ndarray | None) -> Level:
    first = np.flatnonzero(begins)
    return Level(symbols, left, np.cumsum(begins) - 1, np.append(first, len(symbols)))


def grammar(text: np.ndarray) -> list[Level]:
    """Levels of a text of small numbers, until the symbols of a level all differ.

    Block compression makes a symbol of each maximal block of equal symbols, pair compression one of each neighbouring pair whose
    first symbol is of the left and whose second is of the right half of the alphabet. Equal symbols of a level stand for
    equal words, and equal stretches are cut alike but for a unit at each end.
    """
    symbols, different = numbered(text)
    levels: list[Level] = []
    seed = 0
    while different < len(symbols):
        begins = np.append(True, symbols[1:] != symbols[:-1])
        if not begins.all():
            levels.append(cut(symbols, begins, None))
            symbols, different = numbered(symbols[levels[-1].first[:-1]] * (len(symbols) + 1) + np.diff(levels[-1].first))
            continue
        seed += 1
        half = ((np.arange(different, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40 + seed % 16) & np.uint64(1)).astype(bool)
        opens = half[symbols]
        forth, back = opens[:-1] & ~opens[1:], ~opens[:-1] & opens[1:]
        if back.sum() > forth.sum():
            half, forth = ~half, back
        if not forth.any():
            continue
        begins = np.append(True, ~forth)
        levels.append(cut(symbols, begins, half))
        first, size = levels[-1].first[:-1], np.diff(levels[-1].first)
        second = np.where(size == 2, symbols[np.minimum(first + 1, len(symbols) - 1)] + 1, 0)
        symbols, different = numbered(symbols[first] * (different + 1) + second)
    levels.append(cut(symbols, np.ones(len(symbols), bool), None))
    return levels


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from the places a and b on, to the right (step 1) or to the left (step -1); a and b differ.

    Every pair of places climbs while the symbols there agree, past what remains of a unit that began earlier, and comes down
    from where they differ, past the first equal child of each level. The text must begin and end with words of no other place.
    """
    size = len(a)
    leave: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per level: pairs whose symbols differ there
    who, p, q = np.arange(size), a, b

    def remains(level: Level, x: np.ndarray) -> np.ndarray:
        return level.first[level.unit[x] + 1] - x if step > 0 else x - level.first[level.unit[x]] + 1

    for level in levels:
        same = level.symbols[p] == level.symbols[q]
        out = [(who[~same], p[~same], q[~same])]
        who, p, q = who[same], p[same], q[same]
        if level.left is None:
            of_p, of_q = remains(level, p), remains(level, q)
            r = np.minimum(of_p, of_q) * step
            p, q, even = p + r, q + r, of_p == of_q
            out.append((who[~even], p[~even], q[~even]))
            who, p, q = who[even], p[even], q[even]
        else:
            past = (level.left[level.symbols[p]] != (step > 0)) * step
            p, q = p + past, q + past
        leave.append(tuple(np.concatenate(x) for x in zip(*out, strict=True)))
        if not len(who):
            break
        p, q = level.unit[p], level.unit[q]
    who, p, q = leave.pop()
    while leave:
        level = levels[len(leave) - 1]
        if step > 0:
            lengths = np.minimum(level.first[p + 1] - level.first[p], level.first[q + 1] - level.first[q])
            p, q = level.first[p], level.first[q]
        else:
            lengths = np.minimum(level.first[p + 1] - level.first[p], level.first[q + 1] - level.first[q])
            p, q = level.first[p + 1] - 1, level.first[q + 1] - 1
        past = np.where(level.symbols[p] == level.symbols[q], 1 if level.left is not None else lengths, 0) * step
        more = leave.pop()
        who, p, q = np.append(who, more[0]), np.append(p + past, more[1]), np.append(q + past, more[2])
    far = np.empty(size, np.int64)
    far[who] = (p - a[who]) * step
    return far


def runs_of(text: np.ndarray, longest: int, least: int, at_once: int) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of at least max(least, 2 * period) places, by start and period.

    A run of period q has two places of equal words that are neighbours on the grid of multiples of q; all such
    neighbours up to half the longest document are candidates, about n * ln(n) comparisons, and the agreement to both sides gives the run.
    """
    levels = grammar(text)
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    waiting = 0

    def settle() -> None:
        i, q = np.concatenate(places), np.concatenate(periods)
        back = agreement(levels, i - 1, i + q - 1, -1)
        forth = agreement(levels, i, i + q, 1)
        ok = (back + forth >= q) & (back + forth + q >= least)
        rows = np.stack([(i - back)[ok], (i + q + forth)[ok], q[ok]], 1)
        found[:] = [distinct(np.concatenate([*found, rows]))]
        places.clear(), periods.clear()

    for q in range(1, longest // 2 + 1):
        hit = np.flatnonzero(text[:-q:q] == text[q::q])
        if len(hit):
            places.append(hit * q)
            periods.append(np.full(len(hit), q))
            waiting += len(hit)
        if waiting >= at_once:
            settle()
            waiting = 0
    if places:
        settle()
    out = found[0] if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def distinct(rows: np.ndarray) -> np.ndarray:
    """The row of least period of each (start, end): a multiple of the smallest period keeps the same stretch."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, block_words: int = 250_000, at_once: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, runs (array of start, length, period), collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, of at least
    max(least, 2 * q) words, that neither neighbour extends with that period; runs come by start, then period. Collapsed holds
    the words that no run covers after its first q words, joined by one space.

    Documents never meet: blocks of about block_words words (at least one whole document) get one grammar, in which a word of its own
    stands between documents. Candidates are extended at_once at a time, so memory grows with a block's words only. No row moves.

    A null, empty or blank text has no words, no runs and an empty collapsed text. Null and repeated ids are
    documents like others, and no other column is looked at. An empty table gives no rows.
    """
    pattern = re.compile(WORD)

    def block(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        words = pa.array([w for t in texts for w in t], pa.string())
        encoded = words.dictionary_encode()
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes  # place 0 and the place before each start hold separators
        text = len(encoded.dictionary) + np.arange(len(words) + len(texts) + 1, dtype=np.int64)
        inside = np.arange(len(words)) + np.repeat(np.arange(len(texts)) + 1, sizes)
        text[inside] = encoded.indices.to_numpy()
        rows = runs_of(text, int(sizes.max()), least, at_once)
        owner = np.searchsorted(starts, rows[:, 0], "right") - 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        edges = np.zeros(len(text) + 1, np.int64)
        np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
        np.add.at(edges, rows[:, 1], -1)
        kept = np.cumsum(edges)[:-1] == 0
        collapsed = []
        for t, s in zip(texts, starts.tolist(), strict=True):
            keep = kept[s : s + len(t)]
            collapsed.append(" ".join(t if keep.all() else [t[x] for x in np.flatnonzero(keep).tolist()]))
        found = pa.StructArray.from_arrays([pa.array(rows[:, 0] - starts[owner]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, total = 0, [], 0
            for at, value in enumerate(batch.column(1)):
                texts.append(pattern.findall(value.as_py() or ""))
                total += len(texts[-1])
                if total >= block_words or at + 1 == batch.num_rows:
                    ids = batch.column(0).slice(begin, len(texts))
                    out = block(ids.to_pylist(), texts)
                    yield pa.RecordBatch.from_arrays([ids, *out.columns[1:]], ["doc_id", "runs", "collapsed"])
                    begin, texts, total = at + 1, [], 0

    of = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = of.schema["doc_id"].dataType.simpleString()
    return of.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the documents, told by the CRC of the decimal id, repeat one stretch of words to their end.

    Of n words, those from place a = g % n on become the original words a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8) and g = crc div 10;
    these texts are joined by one space. Texts of other documents, of null ids and without words stay.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(F.col("crc") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1))
    n, g = F.size("words").cast("long"), F.floor(F.col("crc") / 10)
    planted = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("crc", crc).withColumn("words", words).withColumn("n", n).withColumn("g", g)
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
        .select("doc_id", F.when((F.col("crc") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    )


def digest(runs: DataFrame) -> DataFrame:
    """The contract's row for each row of periodic_runs; start, length, period and exponent_milli are null where there is no run."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = runs.withColumn("top", best)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
