"""Ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import fresh
from signalframe.llm.quality_rules import count_slice, labelled
from signalframe.llm.tokens import BYTE, Prefix, mix, slices, words

#: Hashed words are runs of ASCII letters and digits, in lower case, and of bytes outside ASCII.
PLAIN = np.arange(256)
BETWEEN = (PLAIN < 128) & ~np.isin(PLAIN, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
LOWER = np.where((PLAIN >= 65) & (PLAIN <= 90), PLAIN + 32, PLAIN).astype(np.uint8)
#: Beside each word its beginnings of so many bytes count as features of their own.
BEGINNINGS = (4, 5)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each document its distinct hashed words and beginnings (places in 2 ** bits weights) and its shape features."""
    start, end, first = words(data, offsets, BETWEEN)
    prefix = Prefix(BYTE[LOWER[data]])
    kinds = [prefix.hashes(start, end)] + [prefix.hashes(start, np.minimum(start + k, end)) ^ np.uint64(k) for k in BEGINNINGS]
    places = np.stack([(mix(x) >> np.uint64(64 - bits)).astype(np.int32) for x in kinds], 1)
    found = [np.unique(places[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    c = count_slice(data, offsets)
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    shape = [c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / n, c["n_distinct"] / n, np.log1p(c["n_words"]) / 8, chars / n / 8]
    return found, np.minimum(np.stack(shape, 1), 4.0)


class Examples:
    """Sparse hashed words and shapes of some documents, with products in both directions."""

    def __init__(self, places: list[np.ndarray], shape: np.ndarray, bits: int, scale: np.ndarray | None = None):
        self.at = np.concatenate(places) if places else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(places)), [len(x) for x in places])
        self.n, self.shape, self.size = len(places), shape, 1 << bits
        self.value = 1.0 if scale is None else scale[self.at]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.at] * self.value, minlength=self.n) + self.shape @ weights[self.size :]

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, weights=slope[self.row] * self.value, minlength=self.size), self.shape.T @ slope])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(examples: Examples, grades: np.ndarray, levels: int, steps: int = 150, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade <= k) = sigmoid(threshold_k - weights . x), by Adam on the whole examples.

    The thresholds stay in order as the first one and positive gaps.
    """
    n, k = len(grades), levels - 1
    free = np.zeros(examples.size + examples.shape.shape[1] + k)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / n, 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    free[-k] = cuts[0]
    free[len(free) - k + 1 :] = np.log(np.maximum(np.diff(cuts), 0.05))
    first, second = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, steps + 1):
        cut = free[-k] + np.concatenate([[0.0], np.cumsum(np.exp(free[len(free) - k + 1 :]))])
        score = examples.scores(free[:-k])
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = sigmoid(edge[grades + 1] - score), sigmoid(edge[grades] - score)
        dh, dl = high * (1 - high), low * (1 - low)
        p = np.maximum(high - low, 1e-9)
        slope = (dh - dl) / p / n  # of the loss by the score
        by_cut = np.array([((grades == i + 1) * dl / p - (grades == i) * dh / p).sum() / n for i in range(k)])
        gaps = np.exp(free[len(free) - k + 1 :])
        grad = np.concatenate([examples.gradient(slope) + decay * free[:-k], [by_cut.sum()], [by_cut[i + 1 :].sum() * gaps[i] for i in range(k - 1)]])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        free -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return free[:-k], free[-k] + np.concatenate([[0.0], np.cumsum(np.exp(free[len(free) - k + 1 :]))])


def telling(places: list[np.ndarray], grades: np.ndarray, levels: int, bits: int, full_z: float, least_docs: int) -> np.ndarray:
    """Scale of each weight, from 0 to 1: the third power of the deviations, over full_z, of its documents' grades at some threshold.

    No wording is screened out for being rare: a smaller scale only makes the penalty on its weight larger. Zero are
    those of fewer than least_docs documents, from which a word cannot be told from its document.
    """
    at = np.concatenate(places)
    row = np.repeat(np.arange(len(places)), [len(x) for x in places])
    docs = np.bincount(at, minlength=1 << bits)
    z = np.zeros(1 << bits)
    for k in range(levels - 1):
        above = (grades > k).astype(np.float64)
        spread = above.std()
        if spread:
            excess = np.bincount(at, weights=above[row], minlength=1 << bits) - docs * above.mean()
            z = np.maximum(z, np.abs(excess) / (spread * np.sqrt(np.maximum(docs, 1))))
    return np.where(docs >= least_docs, np.minimum(z / full_z, 1.0) ** 3, 0.0)


def learn(places: list[np.ndarray], shape: np.ndarray, grades: np.ndarray, levels: int, bits: int, full_z: float, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) to be used on unscaled features."""
    scale = telling(places, grades, levels, bits, full_z, least_docs)
    weights, cuts = fit(Examples([x[scale[x] > 0] for x in places], shape, bits, scale), grades, levels)
    weights[: 1 << bits] *= scale
    return weights, cuts


def calibrate(tail: np.ndarray, clean: np.ndarray, most_lost: float) -> float:
    """The least cut that rejects as many of the other held-out documents as one that loses most_lost of the clean ones; 0.5 without both kinds."""
    if clean.all() or not clean.any():
        return 0.5
    limit = np.sort(tail[clean])[int(most_lost * clean.sum())]
    low = tail[~clean & (tail < limit)].max(initial=0.0)
    return float((low + tail[tail > low].min()) / 2)


def graded(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """doc_id and grade of at most `most` labelled ids: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return labelled(labels, id_col, most).select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, levels: int, bits: int, max_labelled: int, full_z: float = 5.0, least_docs: int = 2, most_lost: float = 0.02) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(weights, thresholds, least chance of the top grade to keep), or None without labels of two grades.

    One task fits the model on at most max_labelled documents; what comes to the driver has 2 ** bits and a few numbers.
    The least chance comes from every fourth document, scored by a model of the other three, and loses most_lost of the clean ones.
    """
    sample = graded(labels, id_col, max_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, 0):
                found, shape = features(data, offsets, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in shape], pa.binary())],
                    names=["doc_id", "grade", "places", "shape"],
                )

    id_type = dict(rows.dtypes)["doc_id"]
    seen = rows.select("text", "doc_id", "grade").mapInArrow(places, f"doc_id {id_type}, grade int, places binary, shape binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def solve(table: pa.Table) -> pa.Table:
        grades = table.column("grade").to_numpy().astype(np.int64)
        if len(set(grades.tolist())) < 2:
            return pa.table({"weights": pa.array([], pa.binary()), "cuts": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        hashed = [np.frombuffer(x, np.int32) for x in table.column("places").to_pylist()]
        shape = np.stack([np.frombuffer(x, np.float64) for x in table.column("shape").to_pylist()])
        held = np.arange(len(grades)) % 4 == 3
        least = 0.5
        if len(set(grades[~held].tolist())) > 1:
            weights, cuts = learn([x for x, h in zip(hashed, held, strict=True) if not h], shape[~held], grades[~held], levels, bits, full_z, least_docs)
            tail = sigmoid(Examples([x for x, h in zip(hashed, held, strict=True) if h], shape[held], bits).scores(weights) - cuts[-1])
            least = calibrate(tail, grades[held] == levels - 1, most_lost)
        weights, cuts = learn(hashed, shape, grades, levels, bits, full_z, least_docs)
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()]), "cuts": pa.array([cuts.tobytes()]), "least": pa.array([least])})

    model = seen.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "weights binary, cuts binary, least double").first()
    return None if model is None else (np.frombuffer(model["weights"], np.float32), np.frombuffer(model["cuts"], np.float64), model["least"])


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tail: float | None = None, bits: int = 18, max_labelled: int = 12_000) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, tail_probability, kept.

    Grades 0 to 2 come from the labels (see graded). One set of weights over hashed words and shape shares, with an
    ordered threshold between each two grades, gives the chance of each grade; expected_grade is its mean and
    tail_probability the chance of the top grade. A document is kept if that is least_tail or more; without least_tail, a
    threshold calibrated on held-out labels, where it loses 2 % of the clean documents at most, takes its place.
    The model is fitted on at most max_labelled labelled documents and scores every document.

    A null text counts as empty and is scored like any other. Rows that repeat an id are scored each by itself. Null ids
    and labels are not learned from. Without labels of two grades the scores are null and all rows are kept. Empty input gives no rows.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    model = train(docs, labels, id_col, text_col, 3, bits, max_labelled)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model[:2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = sent.value
        for batch in batches:
            for a, b, data, offsets in slices(batch, 0):
                found, shape = features(data, offsets, bits)
                above = sigmoid(Examples(found, shape, bits).scores(weights)[:, None] - cuts[None, :])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(above.sum(1)), pa.array(above[:, -1])], names=["doc_id", "expected_grade", "tail_probability"])

    scored = rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= (model[2] if least_tail is None else least_tail))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tail: float | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns. Rows that repeat an id stay if one of them is kept."""
    gone = fresh(docs, "gone")
    rejected = quality_classifier(docs, labels, id_col, text_col, least_tail).groupBy("doc_id").agg(F.max("kept").alias("any")).where(~F.col("any")).select(F.col("doc_id").alias(gone))
    return docs.join(rejected, F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
