"""Substring deduplication by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.tokens import words
from signalframe.llm.windows import Shape, blocked, marked, pipeline, spans_in

SCHEMA = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string"


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self, sequences: Iterable[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, token) -> int:
        """The state of p's strings plus token, as a state of its own."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, token) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token)
        return new

    def matches(self, sequence: Iterable, length: int) -> Iterator[int]:
        """For each place the state of the last `length` tokens, or -1 where they do not occur: matching statistics cut at length.

        Two places have one state exactly if these tokens are the same.
        """
        state = size = 0
        for token in sequence:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            while self.length[state] and self.length[self.link[state]] >= length:
                state = self.link[state]
                size = self.length[state]
            yield state if size >= length else -1


def earlier(length: int):
    """The solver of substring_dedup: contexts of one anchor are a reference shard; all of them stream through its automaton."""

    def again(found: dict) -> list[bytes]:
        anchor, windows = found["anchor"], found["windows"].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(windows)])
        masks = np.zeros(int(cuts[-1]), bool)
        groups = np.concatenate([np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1 if len(anchor) else 0)), [len(anchor)]])
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            shard = [items.split() for items in found["items"][a:b]]
            automaton = Automaton(shard)
            least: dict[int, tuple[int, int]] = {}
            seen = []
            for i, sequence in enumerate(shard, a):
                states = list(automaton.matches(sequence, length))[length - 1 :]
                seen.append(states)
                for place, state in enumerate(states, int(found["start"][i])):
                    at = (int(found["doc"][i]), place)
                    if state not in least or at < least[state]:
                        least[state] = at
            for i, states in enumerate(seen, a):
                doc, start = int(found["doc"][i]), int(found["start"][i])
                masks[cuts[i] : cuts[i + 1]] = [least[s] < (doc, start + j) for j, s in enumerate(states)]
        return spans_in(masks, cuts)

    return again


def spans_of(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, gram: int = 4, heavy: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id (long), n_words, removed (spans of words), kept_text (kept words joined by one space).

    Words are runs of anything but ASCII white space. A word is removed if a window of `length` consecutive words over it
    has a word sequence that also starts earlier: in a document of a smaller id, or before in the same document. Windows are
    judged on the input. See signalframe.llm.windows for how the windows that may repeat are routed to reference shards;
    each shard is one suffix automaton, and the documents' contexts stream through it. An automaton of all references,
    broadcast, would grow with the corpus; a shard holds the contexts of one anchor, or of one window of an anchor that
    occurs more than `heavy` times, and goes to one task. Words are compared as bytes, not by hashes.

    A null text has no words. A null id comes before all others and is returned as null. Rows that repeat an id come at
    the same place in the order, so neither is earlier. Texts of fewer than `length` words stay whole. Empty input gives
    no rows. Other columns are not read.
    """
    shape = Shape(length, gram, True, heavy, block_bytes)
    rows, blocks = blocked(docs, id_col, text_col, shape)

    def encode(data: np.ndarray, offsets: np.ndarray):
        start, end, _ = words(data, offsets)
        raw = data.tobytes()
        return lambda a, b: b" ".join(raw[start[a] : end[b - 1]].split())

    def finish(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        n_words, removed, kept = [], [], []
        for data, offsets, first, covered in marked(table, verdicts, shape):
            raw = data.tobytes()
            for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                found, gone = raw[a:b].split(), covered[i:j]
                n_words.append(j - i)
                removed.append(spans_of(gone) if gone.any() else [])
                kept.append((b" ".join(compress(found, (~gone).tolist())) if removed[-1] else b" ".join(found)).decode())
        ids = table.column("doc").to_numpy()
        spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), "n_words": pa.array(n_words, pa.int64()), "removed": spans, "kept_text": pa.array(kept, pa.string())})

    return pipeline(rows, shape, encode, earlier(length), False, finish, SCHEMA, blocks)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of substring_dedup's rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
