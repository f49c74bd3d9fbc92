"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import materialize, ranked

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids binary"
#: A worker's dictionary of words and their ids starts a new generation at this size, and keeps the one before.
MOST_WORDS = 300_000
TAIL = ".,;:!?#$%&*"
#: Letters that canonical composition leaves as they are and that have one lower case each.
PLAIN = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "\xaa\xb5\xba")
#: The normalizers and pre-tokenizers (fixed value of the tokenizer file) under which a text's ids are those of its words.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether the tokenizer's steps are those above, so that it may be given a text's words one by one."""
    spec = json.loads(tokenizer.to_str())
    normalizer, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = ([x["type"] for x in normalizer.get("normalizers", [])], [x["type"] for x in split.get("pretokenizers", [])])
    return steps == STEPS and split["pretokenizers"][0]["pattern"] == {"Regex": SPLIT} and not split["pretokenizers"][1]["add_prefix_space"]


class Encoder(dict):
    """Token ids of words, and so of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in a row. A new word
    goes through the tokenizer's own normalizer, pre-tokenizer and model. A word of plain letters and closing marks
    comes out of the first two as those letters in lower case, each as the pre-tokenizer writes it, and those marks, so it
    goes to the model at once. All that holds for tokenizers of the known steps (see by_words); any other one gets texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not by_words(self.tokenizer)
        if self.whole:
            return
        self.normalize, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.written = {ord(c): self.split(c.lower())[0][0] for c in PLAIN}
        self.plain = re.compile(f"([{PLAIN}]+)([{re.escape(TAIL)}]*)").fullmatch

    def _part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            ids = self.parts[text] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            known = self.plain(word)
            if known:
                core, tail = known.groups()
                ids = self._part(core.translate(self.written))
                ids = ids + self._part(tail) if tail else ids
            elif "<|" in word:  # may hold the name of a special token
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                ids = b"".join([self._part(part) for part, _ in self.split(self.normalize(word))])
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > MOST_WORDS:
            self.before = dict(self)
            self.clear()
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    kept.append(part if with_ids else None)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    found = rows.mapInArrow(run, PIECES.format(id=dict(rows.dtypes)["doc_id"]))
    return found if with_ids else found.drop("ids")


Run = tuple[int, int, int]  # gap that its sequences had at the start of the round (0: opened in it), first rank there, how many


def sweep(lengths: Mapping[int, int], gaps: Mapping[int, int], capacity: int, opened: int) -> tuple[list[tuple], list[tuple], int]:
    """Best fit of the pieces of a round, by their counts alone.

    lengths and gaps: how many pieces and open sequences there are of each length and gap, at most `capacity` entries
    each. From the longest length down, the pieces go to the sequences of the next larger gap, in the order of their
    ranks, and to new sequences where no gap is large enough. Sequences of one gap stay together as runs of ranks, so
    a run moves in one step and can be filled again in the same round.

    Returns moves (length, first piece, pieces, in each sequence, gap at the start of the round, first sequence, offset),
    closes (gap at the start, first sequence, sequences, gap now), and how many sequences are open or full in all.
    """
    runs: dict[int, list[Run]] = {g: [(g, 0, n)] for g, n in gaps.items() if g > 0}
    moves = []
    for length in sorted(lengths, reverse=True):
        piece, left = 0, lengths[length]
        for gap in [*sorted(g for g in runs if length <= g), capacity]:
            fresh = gap == capacity
            while left and (fresh or runs.get(gap)):
                fits = gap // length
                need = -(-left // fits)
                if fresh:
                    origin, first, count = 0, opened, need
                    opened += need
                else:
                    origin, first, count = runs[gap].pop()
                if count > need:
                    runs.setdefault(gap, []).append((origin, first + need, count - need))
                    count = need
                whole = count if left >= count * fits else count - 1
                for sequences, each in ((whole, fits), (count - whole, left - whole * fits)):
                    if sequences and each:
                        moves.append((length, piece, sequences * each, each, origin, first, capacity - gap))
                        piece, left, first = piece + sequences * each, left - sequences * each, first + sequences
                        runs.setdefault(gap - each * length, []).append((origin, first - sequences, sequences))
    return moves, [(origin, first, count, gap) for gap, found in runs.items() for origin, first, count in found], opened


def numbered(runs: DataFrame, step: int = 1 << 16) -> DataFrame:
    """One row for each number from first to before first + sequences of each run, made in parts of `step`."""
    parts = runs.where("sequences > 0").withColumn("part", F.explode(F.expr(f"sequence(0, (sequences - 1) div {step})")))
    return parts.withColumn("number", F.explode(F.expr(f"sequence(first + part * {step}, first + least(sequences, (part + 1) * {step}) - 1)")))


def pack(found: DataFrame, capacity: int = 2048, rows_per_group: int = 10_000, shrink: int = 8, at: str | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns, with length from 1 to capacity).

    at: a column of numbers from 0 that gives the pieces an order, or none. Pieces of a length then fill sequences in that
    order, and sequences are numbered by their first piece in it.

    Rounds of best fit over bands of lengths, each `shrink` times shorter than the one before: the pieces of a band are ranked within
    their length and the open sequences within their gap, which orders both without sorting all rows in one place. A sweep
    over the counts of lengths and gaps finds each length's successor gaps; ranks settle which piece gets which sequence;
    the gaps are updated and written, and the next round starts. The driver sees the counts of lengths and gaps only.
    """
    spark = found.sparkSession
    table = materialize(found).withColumn("_row", F.monotonically_increasing_id())
    order, spread, top = ([F.col("_row")], F.col("_row"), None) if at is None else ([F.col(at), F.col("piece"), F.col("_row")], F.col(at), table.agg(F.max(at)).first()[0] or 0)
    counted = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins, out, opened, top = None, None, 0, capacity
    while top >= 1:
        low = top // shrink
        band = {length: n for length, n in counted.items() if low < length <= top}
        here = table.where((F.col("length") > low) & (F.col("length") <= top))
        top = low
        if not band:
            continue
        gaps = {} if bins is None else {r["gap"]: r["n"] for r in bins.groupBy("gap").agg(F.count("*").alias("n")).collect()}
        moves, closes, now = sweep(band, gaps, capacity, opened)
        here = ranked(here, ["length"], order, spread, rows_per_group, "_rank", sum(band.values()), top)
        moved = spark.createDataFrame(moves, "l long, first long, pieces long, each long, origin long, sequence long, at long")
        here = here.join(F.broadcast(moved), (F.col("length") == F.col("l")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("pieces")))
        nth = F.col("_rank") - F.col("first")
        here = here.withColumns({"_bin": F.col("sequence") + F.floor(nth / F.col("each")), "offset": F.col("at") + nth % F.col("each") * F.col("length")})
        columns = [*found.columns, "sequence_id", "offset"]
        placed = here.where("origin = 0").withColumn("sequence_id", F.col("_bin")).select(*columns)
        closed = spark.createDataFrame(closes, "origin long, first long, sequences long, now long").where("now > 0")
        state = numbered(closed.where("origin = 0")).select(F.col("number").alias("bin"), F.col("now").alias("gap"))
        if bins is not None:
            open_bins = materialize(ranked(bins, ["gap"], [F.col("bin")], F.col("bin"), rows_per_group, "_at", sum(gaps.values())).select("bin", "gap", "_at"))
            old = here.where("origin > 0").join(open_bins.select("bin", F.col("gap").alias("_gap"), "_at"), (F.col("origin") == F.col("_gap")) & (F.col("_bin") == F.col("_at")))
            placed = placed.union(old.withColumn("sequence_id", F.col("bin")).select(*columns))
            inside = (F.col("gap") == F.col("origin")) & (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("first") + F.col("sequences"))
            state = state.union(open_bins.join(F.broadcast(closed), inside).select("bin", F.col("now").alias("gap")))
        bins = materialize(state)
        placed = materialize(placed)
        out = placed if out is None else out.union(placed)
        opened = now
    if out is None:
        return table.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if at is None:
        return out
    least = materialize(out.groupBy(F.col("sequence_id").alias("_id")).agg(F.min(F.struct(at, "piece")).alias("_least")).select("_id", "_least.*").withColumn("_all", F.lit(0)))
    least = ranked(least, ["_all"], [F.col(at), F.col("piece"), F.col("_id")], F.col(at), rows_per_group, "_number", opened, top)
    return out.join(least.select("_id", "_number"), F.col("sequence_id") == F.col("_id")).withColumn("sequence_id", F.col("_number").cast("long")).drop("_id", "_number")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order: DataFrame | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, if asked for).

    A document is its text's ids and then end_id. Only a document longer than capacity is cut, into pieces of capacity
    ids of which the last may be shorter. Pieces of one sequence lie side by side from offset 0 on.

    A null or empty text is end_id alone. Rows that repeat an id are packed each by itself; a null id is an id like
    others. Empty input gives no rows. Other columns are not read.

    order: one row (_id, _position) for each id of docs, as mixing.positions gives them. Documents then fill sequences in
    the order of their positions as far as best fit leaves a choice, and the sequences are numbered by their least position.
    """
    found = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    if order is None:
        return pack(found, capacity)
    placed = found.join(order, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    return pack(placed, capacity, at="_position").drop("_position")
