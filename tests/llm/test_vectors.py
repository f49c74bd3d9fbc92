import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import WORD, awkward, empty, frame
from pyspark.sql import functions as F

from signalframe.llm import neighbours, periodic_runs, whitening

VECTORS = "vec_id long, embedding array<float>, label int, v int, x int, n string, key long, shard int"


def vectors(spark, pairs):
    return spark.createDataFrame([(i, v, 1, 2, 3, "n", 4, 5) for i, v in pairs], VECTORS)


# --- runs -----------------------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= max(q, least - q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, plant):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    r = random.Random(5)
    out = []
    for _ in range(60):
        k, n = r.choice([1, 2, 3, 9]), r.randrange(90)
        w = [f"w{r.randrange(k)}" for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 6)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append("  ".join(w) + "\n")
    return awkward() + out + ["x y z\x0b" * 40, "a퟿b " * 30]


@pytest.mark.parametrize("block_words, at_once", [(50, 7), (250_000, 1_000_000)])
def test_runs_match_a_plain_scan(spark, block_words, at_once):
    docs = frame(spark, texts()).union(frame(spark, ["a b " * 9, "a b " * 9]).withColumn("doc_id", F.lit(3).cast("long"))).union(frame(spark, ["c " * 30]).withColumn("doc_id", F.lit(None).cast("long")))
    for plant in (False, True):
        of = periodic_runs.with_planted_tails(docs) if plant else docs
        found = periodic_runs.digest(periodic_runs.periodic_runs(of, block_words=block_words, at_once=at_once))
        want = Counter(plain_digest(r.doc_id, r.text, plant) for r in docs.collect())
        assert Counter(tuple(r) for r in found.collect()) == want
        assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_a_tenth_of_the_documents_is_planted(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + i * i).cast("string")) for i in range(40)]).alias("text"))
    rows = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(docs))).collect()
    assert 10 < sum(r.n_runs > 0 for r in rows) < 80
    assert all(tuple(r) == plain_digest(r.doc_id, " ".join(f"w{r.doc_id * 7 + i * i}" for i in range(40)), True) for r in rows)


def test_runs_of_nothing_and_of_long_texts(spark):
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
    long = " ".join(["a b c"] * 40_000)
    row = periodic_runs.digest(periodic_runs.periodic_runs(frame(spark, [long]))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 120_000, 3, 40_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(b"a b c").hexdigest()


# --- neighbours -------------------------------------------------------------------------------------------------------


def brute(rows, k=5):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(ok):
        if i is None or i % 50:
            continue
        near = []
        for other, (j, w) in enumerate(ok):
            if other != at and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                near.append((round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 9), j))
        near.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(near[:k], 1)]
    return Counter(out)


def awkward_vectors():
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in r.integers(-3, 4, 6)]) for i in range(160)]
    rows += [(500 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)]  # one hot vector, two of whose rows are queries
    rows += [(50, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (100, rows[100][1]), (100, rows[100][1])]  # repeated ids, with and without their vector
    rows += [(1000, None), (1050, [0.0] * 6), (1100, [float("nan")] + [1.0] * 5), (1150, [float("inf")] + [1.0] * 5), (1200, [None] + [1.0] * 5), (1250, [])]
    rows += [(None, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (None, [3.0, 1.0, 0.0, -1.0, 0.0, 1.0])]
    rows += [(1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1350, [1.0, 1.0, 1.0])]  # other lengths
    return rows


@pytest.mark.parametrize("shard_vectors", [20, 8192])
def test_nearest_rows_match_brute_force(spark, monkeypatch, shard_vectors):
    index = neighbours.index
    monkeypatch.setattr(neighbours, "index", lambda v, m: index(v, m, shard_vectors))
    rows = awkward_vectors()
    found = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = found.collect()
    want = brute(rows)
    # equal cosines of different vectors may differ in their last bits, so ranks are compared where scores decide
    assert Counter((r.query_id, r["rank"], round(r.score, 9)) for r in got) == Counter((q, rank, s) for (q, rank, _, s), n in want.items() for _ in range(n))
    exact = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got)
    assert (exact & want).total() >= 0.9 * want.total()
    hot = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 500)
    assert hot == [(1, 50), (2, 501), (3, 502), (4, 503), (5, 504)]


def test_few_and_no_vectors(spark):
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(vectors(spark, [(50, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).count() == 0
    rows = neighbours.nearest(vectors(spark, [(50, [1.0, 0.0]), (2, [3e38, 3e38]), (3, [-1e-40, 0.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, round(r.score, 12)) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 2, round(math.sqrt(0.5), 12)), (2, 3, -1.0)]


def test_recall_of_the_graph():
    r = np.random.default_rng(1)
    v = r.standard_normal((3000, 32)) + 2 * r.standard_normal((30, 32))[r.integers(0, 30, 3000)]
    links, entries = neighbours.graph(v)
    unit = neighbours.units(v).astype(np.float32)
    found, _ = neighbours.greedy(unit, links, entries, unit[::30], neighbours.SEARCH_BEAM)
    best = np.argsort(-(unit[::30] @ unit.T), 1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(best, found, strict=True)]) > 0.97
    copies = np.tile(v[:3], (400, 1)) * np.arange(1, 1201)[:, None]  # many vectors of three directions stay reachable
    links, entries = neighbours.graph(copies)
    found, _ = neighbours.greedy(neighbours.units(copies).astype(np.float32), links, entries, unit[:3], 8)
    assert (found >= 0).all() and all((f % 3 == i).all() for i, f in enumerate(found))


# --- whitening --------------------------------------------------------------------------------------------------------


def plain_white(rows, k=16):
    length = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int) + 1_000_000) for i, v in rows if len(v) == length]
    fit = np.unique(np.array([x for _, x in ok]), axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    e, c = np.linalg.eigh(z.T @ z / n)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    keep = e > 1e-10 * e[0]
    return n, {(i, tuple(x)): (int(((n * x - s) ** 2).sum()), (x - s / n) @ c[:, keep] / np.sqrt(e[keep])) for i, x in ok}, e[keep] / np.trace(z.T @ z / n)


@pytest.mark.parametrize("dims, count", [(3, 40), (20, 300), (24, 9)])
def test_whitening_matches_a_plain_version(spark, dims, count):
    r = np.random.default_rng(dims)
    a = r.standard_normal((count, dims)) * np.linspace(0.3, 3, dims)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(a)]
    rows += [(i + 1000, rows[0][1]) for i in range(50)]  # copies weigh nothing
    bad = [(7000, None), (7001, [None] * dims), (7002, [float("nan")] * dims), (7003, [float("inf")] * dims), (7004, [1.0]), (7005, []), (7006, [3e38] * dims)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    n, want, explained = plain_white(rows)
    by = {}
    for row in got:
        by.setdefault(row.vec_id, {})[row.component] = row
    assert set(by) == {i for i, _ in rows} and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = None
    for (i, _), (deviation, white) in want.items():
        found = np.array([by[i][c].whitened for c in range(1, len(white) + 1)])
        assert len(by[i]) == len(white) and by[i][1].deviation == deviation
        sign = np.sign(found * white) if sign is None else sign
        assert np.abs(found * sign - white).max() < 1e-7
        assert np.allclose([by[i][c].explained for c in range(1, len(white) + 1)], explained, rtol=1e-6)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.count() == 0 and out.columns == whitening.SCHEMA.replace(" long", "").replace(" int", "").replace(" double", "").split(", ")
    two = whitening.whiten(vectors(spark, [(None, [0.0, 5.0]), (1, [1.0, 5.0]), (1, [1.0, 5.0])])).collect()
    assert sorted(abs(r.whitened) for r in two) == [1.0, 1.0, 1.0] and {r.component for r in two} == {1}
    big = whitening.whiten(vectors(spark, [(1, [1e16, 1.0]), (2, [-1e16, 3.0])])).collect()
    assert [r.deviation for r in big] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-12 for r in big)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]), max_dims=1)


def test_eigenvectors_of_awkward_matrices():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.standard_normal((30, 30)))
    cases = [np.eye(20), np.diag(np.arange(25.0)), q @ np.diag([5.0] * 5 + [3.0] * 5 + [1 + 1e-13 * i for i in range(10)] + [0.1] * 10) @ q.T, np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)]
    for v in cases:
        w, z = whitening.components(v, 16)
        assert np.abs(w - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-13 * w[0]
        assert np.abs(v @ z.T - z.T * w).max() < 1e-13 * w[0] and np.abs(z @ z.T - np.eye(16)).max() < 1e-13
