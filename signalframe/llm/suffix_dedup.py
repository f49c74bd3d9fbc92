"""Removal of repeated byte strings by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.substring_dedup import spans_of
from signalframe.llm.tokens import LOW, eights
from signalframe.llm.windows import Shape, blocked, marked, pipeline, spans_in

SCHEMA = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def equal_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Places in `start` of suffixes that share their first `length` bytes with another one of their group.

    weight: how many times each suffix occurs. Most-significant-digit passes of eight bytes each: a pass sorts each group by
    the next digit, which splits it, and a suffix that is alone in its group leaves. No pass looks beyond `length`.
    """
    digits = eights(data)
    left = np.arange(len(start))
    for depth in range(0, length, 8):
        digit = digits[start[left] + depth] & LOW[min(8, length - depth)]
        order = np.lexsort((digit, group))
        left, digit, group = left[order], digit[order], group[order]
        head = np.ones(len(left), bool)
        head[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(head) - 1
        keep = np.bincount(group, weights=weight[left])[group] > 1 if len(left) else head
        left, group = left[keep], group[keep]
    return left


def elsewhere(length: int):
    """The solver of suffix_dedup: radix passes over the windows of all contexts, as often as they occur.

    The first digit is the anchor and its place in the window, which equal windows share; the passes go on within it.
    """

    def again(found: dict) -> list[bytes]:
        windows = found["windows"].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(windows)])
        masks = np.zeros(int(cuts[-1]), bool)
        anchor = found["anchor"]
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = anchor[1:] == anchor[:-1]
        alone = ~(same[:-1] | same[1:])
        masks[np.repeat(alone & (found["n"] > 1), windows)] = True  # one context of its anchor: all that is in these groups is equal
        picked = np.flatnonzero(~alone)
        data = np.frombuffer(b"".join([found["items"][i] for i in picked]), np.uint8)
        base = np.cumsum([0, *[len(found["items"][i]) for i in picked]])[:-1]
        owner = np.repeat(np.arange(len(picked)), windows[picked])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows[picked]) - windows[picked], windows[picked])
        digit = np.cumsum(np.diff(anchor[picked], prepend=0) != 0)[owner] * (2 * length) + found["at"][picked][owner] - offset
        hit = equal_groups(data, base[owner] + offset, digit, found["n"][picked][owner], length)
        masks[(cuts[picked][owner] + offset)[hit]] = True
        return spans_in(masks, cuts)

    return again


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, heavy: int = 16_384, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id (long), n_bytes, removed (spans of bytes), kept (the bytes that stay).

    A byte of a text's UTF-8 form is removed if a string of `length` bytes over it also starts anywhere else, in the same
    document or another; strings are judged on the input and never cross documents. See signalframe.llm.windows for how
    suffixes are dealt by their first digit, the anchor of their first `length` bytes; within the groups, radix passes of
    eight bytes finish the order up to depth `length`. Suffixes of the same context are one suffix that counts as often as
    it occurs. Bytes are compared, not hashes.

    A null text counts as empty, and its id is returned. A null id is an id like others. Rows that repeat an id are
    documents of their own. Texts shorter than `length` bytes stay whole. Empty input gives no rows. Other columns are not read.
    """
    shape = Shape(length, gram, False, heavy, block_bytes)
    rows, blocks = blocked(docs, id_col, text_col, shape)

    def encode(data: np.ndarray, offsets: np.ndarray):
        raw = data.tobytes()
        return lambda a, b: raw[a:b]

    def finish(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        sizes, removed, kept = [], [], []
        for data, offsets, _, covered in marked(table, verdicts, shape):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                gone = covered[a:b]
                sizes.append(b - a)
                removed.append(spans_of(gone) if gone.any() else [])
                kept.append((data[a:b][~gone] if removed[-1] else data[a:b]).tobytes())
        ids = table.column("doc").to_numpy()
        spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), "n_bytes": pa.array(sizes, pa.int64()), "removed": spans, "kept": pa.array(kept, pa.binary())})

    return pipeline(rows, shape, encode, elsewhere(length), True, finish, SCHEMA, blocks)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of suffix_dedup's rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
