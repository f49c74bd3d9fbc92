"""Learned decision lists over text statistics, emitted as Spark conditional expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import materialize
from signalframe.llm.tokens import ODD, codes_of, joined, mix, same, slices, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?;:\"'()[]{}@_~^=+\\/`", np.uint8))

#: Statistics that literals compare with a threshold, as SQL over the counts.
STATISTICS = {
    "words": "double(n_words)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def alike(data: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether stretch i has the bytes of stretch j."""
    size = end[i] - start[i]
    out = size == end[j] - start[j]
    out[out] = same(data, start[i][out], start[j][out], size[out])
    return out


def groups(owner: np.ndarray, codes: np.ndarray, equal: Callable, key: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the first of each group of equal things of one document, and of each thing its group.

    Things of one code are compared by equal(i, j), byte for byte; where codes ever collide, key(i) groups instead.
    """
    _, first, which = np.unique(mix(codes + (owner.astype(np.uint64) + np.uint64(1)) * ODD), return_index=True, return_inverse=True)
    later = np.flatnonzero(first[which] != np.arange(len(which)))
    before = first[which[later]]
    if (owner[later] == owner[before]).all() and equal(later, before).all():
        return first, which
    seen: dict = {}
    which = np.array([seen.setdefault((int(o), key(i)), len(seen)) for i, o in enumerate(owner)])
    return np.unique(which, return_index=True)[1], which


def count_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    docs = len(offsets) - 1
    start, end, first = words(data, offsets)
    total = np.diff(first)
    owner = np.repeat(np.arange(docs), total)
    of_byte = np.repeat(np.arange(docs), np.diff(offsets))

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    in_word = np.cumsum(inside[:-1]).astype(bool)
    out = {"n_words": total, "word_chars": per_doc(in_word & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[data])}
    out |= {"n_upper": per_doc(UPPER[data]), "n_digits": per_doc(DIGITS[data]), "n_marks": per_doc(MARKS[data])}
    # Lines: cut after each line feed and at the documents' edges.
    edges = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]]))
    edges = edges[edges < len(data)]
    stops = np.concatenate([edges[1:], [len(data)]]) if len(edges) else edges
    stops = stops - ((data[stops - 1] == 10) if len(stops) else 0)
    filled = np.concatenate([[0], np.cumsum(in_word)])
    real = filled[stops] > filled[edges] if len(edges) else np.zeros(0, bool)
    edges, stops = edges[real], stops[real]
    line_owner = of_byte[edges]
    lines = np.bincount(line_owner, minlength=docs)
    raw = data.tobytes()
    once, _ = groups(line_owner, codes_of(data, edges, stops), lambda i, j: alike(data, edges, stops, i, j), lambda i: raw[edges[i] : stops[i]])
    out |= {"n_lines": lines, "n_dup_lines": lines - np.bincount(line_owner[once], minlength=docs)}
    codes = codes_of(data, start, end)
    once, _ = groups(owner, codes, lambda i, j: alike(data, start, end, i, j), lambda i: raw[start[i] : end[i]])
    out["n_distinct"] = np.bincount(owner[once], minlength=docs)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    three = lambda i, j: np.logical_and.reduce([alike(data, start, end, at[i] + k, at[j] + k) for k in range(3)])
    _, which = groups(owner[at], joined(codes, at, 3), three, lambda i: tuple(raw[start[at[i] + k] : end[at[i] + k]] for k in range(3)))
    again = at[np.bincount(which)[which] > 1] if len(at) else at
    covered = np.zeros(len(owner), bool)
    for step in range(3):
        covered[again + step] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=docs)
    return out


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the counts of each text; a null text has none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, 1):
                found = count_slice(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(found[c], pa.int64()) for c in COUNTS + MORE]], names=["doc_id", *COUNTS, *MORE])

    return rows.mapInArrow(run, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *[f"{c} long" for c in COUNTS + MORE]]))


Literal = tuple[str, bool, float]


def covers(rule: Sequence[Literal], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for name, above, cut in rule:
        hit &= (table[name] > cut) if above else (table[name] <= cut)
    return hit


def learn(table: dict[str, np.ndarray], bad: np.ndarray, rules: int = 12, literals: int = 4, cuts: int = 40, precision: float = 0.95, least: int = 3) -> list[list[Literal]]:
    """An ordered list of threshold conjunctions that find bad rows, by sequential covering.

    Two of three rows grow a rule, literal by literal, by information gain; the third prunes it, dropping last literals
    while that does not lower (hits - misses) / covered. A rule with less than the wanted precision on either part ends
    the list; rows that a rule covers leave the table before the next one.
    """
    n = len(bad)
    part = np.arange(n) % 3 == 2
    left, found = np.ones(n, bool), []
    marks = {c: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[:-1])) for c, v in table.items()} if n else {}
    for _ in range(rules):
        grow, prune = left & ~part, left & part
        rule: list[Literal] = []
        hit = grow.copy()
        while len(rule) < literals and (hit & ~bad).any() and (hit & bad).any():
            base = np.log2((hit & bad).sum() / hit.sum())
            best = (0.0, None, None)
            for name, values in table.items():
                now, good = values[hit], bad[hit]
                order = np.argsort(now, kind="stable")
                hits = np.concatenate([[0], np.cumsum(good[order])])
                at = np.searchsorted(now[order], marks[name], "right")
                for above, p, t in ((False, hits[at], at), (True, hits[-1] - hits[at], len(now) - at)):
                    score = np.where(p >= least, p * (np.log2(np.maximum(p, 1) / np.maximum(t, 1)) - base), 0)
                    k = int(np.argmax(score))
                    if score[k] > best[0] + 1e-9:
                        best = (float(score[k]), (name, above, float(marks[name][k])), None)
            if best[1] is None:
                break
            rule.append(best[1])
            hit = grow & covers(rule, table, n)

        def worth(r: list[Literal], prune: np.ndarray = prune) -> float:
            c = prune & covers(r, table, n)
            return (2 * (c & bad).sum() - c.sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = covers(rule, table, n) & left
        if not rule or any((hit & p & bad).sum() < precision * max(1, (hit & p).sum()) for p in (part, ~part)) or (hit & bad).sum() < least:
            break
        found.append(rule)
        left &= ~hit
    return found


def emitted(rules: Sequence[Sequence[Literal]]) -> tuple[Column, Column]:
    """(verdict, rule): the ordered list as conditional expressions; false and the rule's number from 1, or true and 0."""
    verdict, number = None, None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, above, cut in rule:
            value = F.expr(STATISTICS[name])
            test = test & ((value > cut) if above else (value <= cut))
        verdict = F.when(test, False) if verdict is None else verdict.when(test, False)
        number = F.when(test, i) if number is None else number.when(test, i)
    return (F.lit(True), F.lit(0)) if verdict is None else (verdict.otherwise(True), number.otherwise(0))


def labelled(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """doc_id, quality, toxic of at most `most` labelled ids, those with the smallest hashes; repeated labels take the worst."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    return rows.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows found twice or more in the text.
    kept is false where that holds; elsewhere the decision list says it. The list is learned from the statistics of at
    most max_labelled labelled documents (quality 0 is bad) and applied to all documents as one conditional expression.
    rule is the number of the rule that fired, from 1; 0 if none did or the base failed.

    A null or empty text has no words, so its base fails. Rows that repeat an id are judged each by itself. Null ids and
    labels are not learned from. Without labels of both kinds the list is empty. Empty input gives no rows.
    """
    stats = materialize(counts(docs, id_col, text_col))
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    sample = labelled(labels, id_col, max_labelled)
    values = [F.expr(sql).alias(name) for name, sql in STATISTICS.items()]
    seen = stats.where(~base).join(F.broadcast(sample), "doc_id").select("doc_id", F.struct("quality", *values).alias("row"))
    rows = seen.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toArrow()
    table = {name: rows.column(name).to_numpy() for name in STATISTICS}
    rules = learn(table, rows.column("quality").to_numpy() == 0)
    verdict, number = emitted(rules)
    return stats.select("doc_id", *COUNTS, base.alias("base_failed"), F.when(base, False).otherwise(verdict).alias("kept"), F.when(base, 0).otherwise(number).alias("rule"))
