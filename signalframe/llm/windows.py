"""Windows of a fixed length that occur again: routing by minimizers, shared by the two exact substring operators.

Every window of `length` items has an anchor: of its stretches of `gram` items the one of the smallest hash, the
leftmost of equal ones. The anchor depends on the window's content alone, so equal windows have equal anchors at equal
places. Consecutive windows of a document with the same anchor form a run; a run and its items are a context.

1. Documents are dealt to blocks of about block_bytes of text. Each block names its distinct anchors once.
2. Anchors that occur twice or more in all are sent back to their blocks, one row per block however often they occur.
3. Each block sends the distinct contexts of these anchors once, with the places where they lie in the block. A hot anchor,
   one with more than `heavy` occurrences, is split: its windows go one by one, each under its own digest. Of such a key a
   block sends one row, so no group outgrows the number of blocks or `heavy`.
4. Contexts meet by anchor. A solver (suffix automata or radix passes over their items) says which windows occur again.
5. The verdicts go back to the blocks, one row per block and context, and each block marks its documents.

Hashes of anchors only route: what meets is told apart by 128 bits of BLAKE2b of the items and then by the items
themselves. No step groups by anything whose size grows with a hot passage, beyond one row per block. The documents are
shuffled once: all steps are one plan and share that exchange. A text longer than a block is a block of its own, looked
at `chunk` windows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.tokens import BYTE, Prefix, slices, word_codes

PLACE_BITS = np.uint64(28)
CONTEXTS = "anchor long, context binary, at int, windows int, doc long, start long, lead int, block int, places binary, items binary"
VERDICTS = "block int, windows int, lead int, places binary, spans binary"


@dataclass(frozen=True)
class Shape:
    """length: items of a window; gram: items of an anchor; by_words: items are words, else bytes."""

    length: int
    gram: int
    by_words: bool
    heavy: int
    block_bytes: int = 8 << 20
    slice_bytes: int = 1 << 19
    chunk: int = 1 << 20


@dataclass
class Runs:
    """Runs of some windows of a slice: anchor hash, its place, first window and number of windows."""

    anchor: np.ndarray
    place: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def find_runs(codes: np.ndarray, first: np.ndarray, shape: Shape) -> Iterator[Runs]:
    """All runs of the documents whose items start at first[:-1], first[-1] being the end of the last; a run ends at the end of a chunk."""
    total = len(codes) - shape.length + 1
    for low in range(0, max(0, total), shape.chunk):
        n = min(shape.chunk, total - low)
        part = codes[low : low + n + shape.length - 1]
        at = np.arange(len(part) - shape.gram + 1)
        grams = Prefix(part).hashes(at, at + shape.gram)
        packed = (grams >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
        place = (sliding_min(packed, shape.length - shape.gram + 1) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        window = np.arange(low, low + n)
        real = window + shape.length <= first[np.searchsorted(first, window, "right")]
        change = np.ones(n, bool)
        change[1:] = (place[1:] != place[:-1]) | (real[1:] != real[:-1])
        start = np.flatnonzero(change)
        windows = np.diff(np.concatenate([start, [n]]))
        keep = real[start]
        start, windows = start[keep], windows[keep]
        yield Runs(grams[place[start]], place[start] + low, start + low, windows)


def items_of(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    return word_codes(data, offsets) if shape.by_words else (BYTE[data], offsets)


def table_slices(table: pa.Table, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a block's documents (columns doc, text, block)."""
    row = 0
    for batch in table.select(["doc", "text"]).combine_chunks().to_batches():
        for a, _, data, offsets in slices(batch, 1, shape.slice_bytes):
            yield row + a, data, offsets
        row += batch.num_rows


def in_order(table: pa.Table) -> pa.Table:
    """The documents of a block in an order that each task finds again."""
    return table.sort_by([("doc", "ascending"), ("text", "ascending")])


def blocked(docs: DataFrame, id_col: str, text_col: str, shape: Shape) -> tuple[DataFrame, int]:
    """(doc, text, block) and the number of blocks, as many as the volume of text asks for. A null id becomes the least long."""
    volume = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(1, -(-volume // shape.block_bytes))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(ident.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.pmod(F.xxhash64(id_col, F.octet_length(text_col)), F.lit(blocks)).cast("int").alias("block"))
    return rows, blocks


def anchors(rows: DataFrame, shape: Shape) -> DataFrame:
    """(anchor, block, n): the distinct anchors of each block."""

    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for _, data, offsets in table_slices(table, shape):
            found += [runs.anchor for runs in find_runs(*items_of(data, offsets, shape), shape)]
        anchor, n = np.unique(np.concatenate(found), return_counts=True)
        block = table.column("block")[0].as_py()
        return pa.table({"anchor": pa.array(anchor.view(np.int64)), "block": pa.array(np.full(len(anchor), block, np.int32)), "n": pa.array(n.astype(np.int64))})

    return rows.groupBy("block").applyInArrow(run, "anchor long, block int, n long")


def repeated(found: DataFrame, heavy: int) -> DataFrame:
    """(block, anchor, heavy) of the anchors that occur more than once. A hot anchor has one small row a block here, of 24 bytes for 8 MB of text."""
    total = found.withColumn("total", F.expr("sum(n) over (partition by anchor)"))
    return total.where("total > 1").select("block", "anchor", (F.col("total") > heavy).alias("heavy"))


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Found:
    """The distinct contexts of a block. Of each: its first occurrence (doc, then start) and the places of all, those that share doc and start with it ahead."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.first: list[tuple[int, int]] = []
        self.lead: list[list[int]] = []
        self.rest: list[list[int]] = []

    def add(self, items: bytes, anchor: int | None, at: int, windows: int, doc: int, start: int, place: int) -> None:
        digest = blake2b(items, digest_size=16).digest()
        k = self.seen.get(digest)
        if k is None:
            self.seen[digest] = len(self.rows)
            self.rows.append((int.from_bytes(digest[:8], "little", signed=True) if anchor is None else anchor, digest, at, windows, items))
            self.first.append((doc, start))
            self.lead.append([place])
            self.rest.append([])
        elif (doc, start) == self.first[k]:
            self.lead[k].append(place)
        elif (doc, start) < self.first[k]:
            self.rest[k] += self.lead[k]
            self.first[k], self.lead[k] = (doc, start), [place]
        else:
            self.rest[k].append(place)

    def table(self, block: int) -> pa.Table:
        anchor, digest, at, windows, items = zip(*self.rows, strict=True) if self.rows else ((),) * 5
        kinds = {"anchor": (anchor, pa.int64()), "context": (digest, pa.binary()), "at": (at, pa.int32()), "windows": (windows, pa.int32())}
        kinds |= {"doc": ([d for d, _ in self.first], pa.int64()), "start": ([s for _, s in self.first], pa.int64()), "lead": ([len(x) for x in self.lead], pa.int32())}
        kinds |= {"block": ([block] * len(self.rows), pa.int32()), "places": ([np.array(a + b, "<i8").tobytes() for a, b in zip(self.lead, self.rest, strict=True)], pa.binary()), "items": (items, pa.binary())}
        return pa.table({c: pa.array(x, k) for c, (x, k) in kinds.items()})


def contexts(rows: DataFrame, wanted: DataFrame, shape: Shape, encode: Callable) -> DataFrame:
    """The distinct contexts of the wanted anchors in each block. encode(data, offsets) gives a function (start, end) -> bytes of items."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        keys = asked.column("anchor").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, heavy = keys[order], asked.column("heavy").to_numpy(zero_copy_only=False)[order]
        table = in_order(table)
        ids = table.column("doc").to_numpy()
        found, base = Found(), 0
        for row, data, offsets in table_slices(table, shape) if len(keys) and table.num_rows else ():
            codes, first = items_of(data, offsets, shape)
            take = encode(data, offsets)
            for runs in find_runs(codes, first, shape):
                at = lookup(keys, runs.anchor)
                owner = np.searchsorted(first, runs.start, "right") - 1
                hit = np.flatnonzero(at >= 0)
                columns = (runs.anchor.view(np.int64), runs.place - runs.start, runs.start, runs.windows, ids[row + owner], first[owner], heavy[np.maximum(at, 0)])
                for anchor, place, s, w, doc, b, hot in zip(*[x[hit].tolist() for x in columns], strict=True):
                    if hot:
                        for k in range(s, s + w):
                            found.add(take(k, k + shape.length), None, 0, 1, doc, k - b, base + k)
                    else:
                        found.add(take(s, s + w + shape.length - 1), anchor, place, w, doc, s - b, base + s)
            base += len(codes)
        return found.table((table if table.num_rows else asked).column("block")[0].as_py())

    return rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, CONTEXTS)


def spans_in(mask: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Of each part mask[cuts[i]:cuts[i + 1]] its runs of true as pairs of places in the part, 32 bits each."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[cuts] = True
    head, tail = mask.copy(), mask.copy()
    head[1:] &= ~mask[:-1] | edge[1:-1]
    tail[:-1] &= ~mask[1:] | edge[1:-1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    owner = np.searchsorted(cuts, start, "right") - 1
    raw = np.stack([start - cuts[owner], end - cuts[owner]], 1).astype("<i4").tobytes()
    at = (8 * np.searchsorted(owner, np.arange(len(cuts)))).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def solved(found: DataFrame, packs: int, again: Callable[[dict], list], alike: bool) -> DataFrame:
    """Verdicts for the contexts of each block.

    again gets the distinct contexts of a pack in the order of anchor, then first place (anchor, at, windows, n, doc,
    start, items), and returns for each the spans of its windows that occur again, as spans_in does. With alike they hold
    for all its occurrences; else for the first one, and all windows of the others occur again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        items: list[bytes] = []
        kept: dict[str, list] = {c: [] for c in ("anchor", "at", "windows", "doc", "start", "lead", "block", "of")}
        places: list[bytes] = []
        for batch in batches:  # of a context that many blocks send, the items are held once
            of, blobs = [], batch.column("items")
            for i, digest in enumerate(batch.column("context").to_pylist()):
                k = seen.setdefault(digest, len(items))
                if k == len(items):
                    items.append(blobs[i].as_py())
                of.append(k)
            for c, x in kept.items():
                x.append(np.array(of, np.int64) if c == "of" else batch.column(c).to_numpy())
            places += batch.column("places").to_pylist()
        row = {c: np.concatenate(x) for c, x in kept.items()}
        here = np.array([len(x) // 8 for x in places], np.int64)
        order = np.lexsort((row["start"], row["doc"], row["of"]))
        first = order[np.flatnonzero(np.diff(row["of"][order], prepend=-1))]
        n = np.bincount(row["of"], weights=here).astype(np.int64)
        sequence = np.lexsort((row["start"][first], row["doc"][first], row["anchor"][first]))
        picked = first[sequence]
        spans: list[bytes] = [b""] * len(items)
        asked = {c: row[c][picked] for c in ("anchor", "at", "windows", "doc", "start")} | {"n": n[sequence], "items": [items[k] for k in sequence.tolist()]}
        for k, x in zip(sequence.tolist(), again(asked), strict=True):
            spans[k] = x
        top = first[row["of"]]
        is_first = (row["doc"] == row["doc"][top]) & (row["start"] == row["start"][top])
        lead = here if alike else np.where(is_first, row["lead"], 0)
        keep = np.array([bool(spans[k]) for k in row["of"].tolist()], bool) | (lead < here)
        out = np.flatnonzero(keep).tolist()
        columns = [pa.array(row["block"][keep], pa.int32()), pa.array(row["windows"][keep], pa.int32()), pa.array(lead[keep], pa.int32())]
        columns += [pa.array([places[i] for i in out], pa.binary()), pa.array([spans[row["of"][i]] for i in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "windows", "lead", "places", "spans"])

    packed = found.withColumn("pack", F.pmod(F.xxhash64("anchor"), F.lit(packs)))
    return packed.groupBy("pack").applyInArrow(run, VERDICTS)


def repeats(verdicts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted first windows, and sorted ends, of the stretches of windows that occur again, as places in the block."""
    lead, windows = (verdicts.column(c).to_numpy().astype(np.int64) for c in ("lead", "windows"))
    raw = [verdicts.column(c).to_pylist() for c in ("places", "spans")]
    n_places, n_spans = (np.array([len(x) // 8 for x in column], np.int64) for column in raw)
    place = np.frombuffer(b"".join(raw[0]), "<i8")
    span = np.frombuffer(b"".join(raw[1]), "<i4").reshape(-1, 2).astype(np.int64)
    place_from, span_from = np.cumsum(n_places) - n_places, np.cumsum(n_spans) - n_spans

    def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number in the row) of counts[row] entries of each row."""
        row = np.repeat(np.arange(len(counts)), counts)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)

    row, k = within(lead * n_spans)
    at = place[place_from[row] + k // np.maximum(n_spans[row], 1)]
    some = span[span_from[row] + k % np.maximum(n_spans[row], 1)]
    row, k = within(n_places - lead)
    rest = place[place_from[row] + lead[row] + k]
    return np.sort(np.concatenate([at + some[:, 0], rest])), np.sort(np.concatenate([at + some[:, 1], rest + windows[row]]))


def marked(table: pa.Table, verdicts: pa.Table, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, first, covered) of slices of a block: which items lie in a window that occurs again."""
    starts, ends = repeats(verdicts)
    ends = ends + shape.length - 1
    base = 0
    for _, data, offsets in table_slices(table, shape):
        first = word_codes(data, offsets)[1] if shape.by_words else offsets
        n = int(first[-1])
        depth = np.zeros(n + 1, np.int64)
        for places, step in ((starts, 1), (ends, -1)):
            lo, hi = np.searchsorted(places, base + (step < 0)), np.searchsorted(places, base + n, "left" if step > 0 else "right")
            depth += step * np.bincount(places[lo:hi] - base, minlength=n + 1)
        yield data, offsets, first, np.cumsum(depth[:-1]) > 0
        base += n


def pipeline(rows: DataFrame, shape: Shape, encode: Callable, again: Callable, alike: bool, finish: Callable, schema: str, blocks: int) -> DataFrame:
    """All steps as one plan; finish(table, verdicts) gives a block's result rows."""
    wanted = repeated(anchors(rows, shape), shape.heavy)
    verdicts = solved(contexts(rows, wanted, shape, encode), 2 * blocks, again, alike)
    return rows.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(lambda table, verdicts: finish(in_order(table), verdicts), schema)
