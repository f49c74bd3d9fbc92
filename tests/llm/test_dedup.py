import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from signalframe.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup, windows
from signalframe.llm.common import components
from signalframe.llm.substring_dedup import Automaton

from helpers import WORD, awkward, empty, frame, plain_links, sentence


def test_exact_dedup_matches_plain_grouping(spark):
    texts = awkward() + ["hot"] * 200 + ["", None]
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), capacity=7).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts, 1):
        groups[t or ""].append(i)
    assert len(found) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(same).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in found) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup.keep_one(frame(spark, ["x", "x", "y"])).columns == frame(spark, ["x"]).columns


def test_keep_one_keeps_unique_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, None), (1, "a"), (2, "c"), (2, "d"), (3, "c"), (4, "")]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "b"), (1, "a"), (2, "d"), (3, "c"), (4, "")]


def test_misra_gries_keeps_every_frequent_digest(spark):
    values = ["a"] * 50 + ["b"] * 40 + [f"c{i}" for i in range(110)]
    random.Random(1).shuffle(values)
    digests = spark.createDataFrame([(v,) for v in values], "digest string").repartition(5)
    found = {r.digest for r in exact_dedup.frequent(digests, "digest", 9, 200).collect()}
    assert {"a", "b"} <= found and len(found) <= 9


def plain_windows(texts, length):
    """n_words, n_removed and digest by the contract of the word windows."""
    first, out = set(), {}
    for i, t in enumerate(texts, 1):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            key = tuple(words[a : a + length])
            if key in first:
                gone[a : a + length] = [True] * length
            first.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def plain_bytes(texts, length):
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[a : a + length] for d in datas for a in range(len(d) - length + 1))
    out = {}
    for i, d in enumerate(datas, 1):
        gone = [False] * len(d)
        for a in range(len(d) - length + 1):
            if count[d[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest())
    return out


def mosaic(seed, docs=40):
    r = random.Random(seed)
    parts = [sentence(100 + i, r.randint(5, 60)) for i in range(12)]
    return [" ".join(r.choice(parts) if r.random() < 0.6 else sentence(r.randint(1000, 9999), r.randint(1, 40)) for _ in range(r.randint(0, 6))) for _ in range(docs)]


@pytest.mark.parametrize("heavy", [1, 5, 4096])
def test_substring_dedup_matches_plain_windows(spark, heavy):
    texts = awkward() + mosaic(1)
    found = substring_dedup.digest(substring_dedup.substring_dedup(frame(spark, texts), heavy=heavy, block_bytes=20_000)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == plain_windows(texts, 20)


@pytest.mark.parametrize("heavy", [1, 5, 16_384])
def test_suffix_dedup_matches_plain_bytes(spark, heavy):
    texts = awkward() + mosaic(2)
    found = suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, texts), heavy=heavy, block_bytes=20_000)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == plain_bytes(texts, 200)


def thue_morse(n, a="a", b="b"):
    """2 ** n letters; a polynomial hash modulo 2 ** 64 takes this string and its complement for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join(b if x else a for x in bits)


def test_window_operators_compare_contents_not_hashes(spark):
    words = sentence(21, 40).split()
    texts = [" ".join([*words[:10], thue_morse(10, *x), *words[10:]]) for x in ("ab", "ba", "ab")]
    texts += [sentence(22, 30) + thue_morse(12, *x) + sentence(23, 30) for x in ("cd", "dc")]
    for heavy in (1, 100):
        found = substring_dedup.digest(substring_dedup.substring_dedup(frame(spark, texts), heavy=heavy, block_bytes=500)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == plain_windows(texts, 20)
        found = suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, texts), heavy=heavy, block_bytes=3000)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == plain_bytes(texts, 200)


def test_window_operators_on_texts_longer_than_a_slice(spark):
    part = sentence(31, 3000)
    texts = [sentence(32, 60_000) + " " + part + " " + sentence(33, 9000), part + " \t" + sentence(34, 50), "z" * 700_000 + part, sentence(34, 50).replace(" ", "  ")]
    found = substring_dedup.digest(substring_dedup.substring_dedup(frame(spark, texts), block_bytes=200_000)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == plain_windows(texts, 20)
    found = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, texts), block_bytes=200_000)).collect()}
    size = len(part.encode())
    assert found[2].n_removed >= size and found[3].n_removed >= 700_000 + size and found[1].n_removed >= size
    assert found[4].n_removed == 0 and found[3].n_spans == 1


def test_runs_and_spans_do_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    codes, first = rng.integers(0, 3, 500).astype(np.uint64), np.array([0, 130, 135, 135, 420, 500])
    for chunk in (1, 7, 64, 10_000):
        covered = {}
        for runs in windows.find_runs(codes, first, windows.Shape(9, 3, True, 5, chunk=chunk)):
            for s, w, p in zip(runs.start.tolist(), runs.windows.tolist(), runs.place.tolist()):
                covered |= {k: p for k in range(s, s + w)}
        assert covered == {k: covered[k] for k in range(500) if any(a <= k and k + 9 <= b for a, b in zip(first[:-1], first[1:]))}
        one = covered if chunk == 1 else one
        assert one == covered
    mask = np.array([1, 1, 0, 1, 1, 1, 0, 1], bool)
    assert [np.frombuffer(x, "<i4").tolist() for x in windows.spans_in(mask, np.array([0, 4, 4, 7, 8]))] == [[0, 2, 3, 4], [], [0, 2], [0, 1]]


def test_equal_groups_are_the_repeated_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    start = np.arange(3000 - 19)
    count = Counter(data[a : a + 19].tobytes() for a in start)
    found = suffix_dedup.equal_groups(data, start, np.zeros(len(start), np.int64), np.ones(len(start), np.int64), 19)
    assert sorted(found.tolist()) == [a for a in start.tolist() if count[data[a : a + 19].tobytes()] > 1]
    assert len(suffix_dedup.equal_groups(data, start, np.zeros(len(start), np.int64), np.full(len(start), 2), 19)) == len(start)


def test_window_operators_edges(spark):
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    text = sentence(9, 100)
    twice = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    found = substring_dedup.substring_dedup(twice).collect()
    assert sorted((r.doc_id or 0, len(r.removed), r.kept_text == text) for r in found) == [(0, 0, True), (1, 1, False), (1, 1, False), (2, 1, False)]
    assert all(r.kept == b"" for r in suffix_dedup.suffix_dedup(twice).collect())


def test_automaton_states_tell_windows_apart():
    r = random.Random(4)
    for _ in range(30):
        shard = [[r.choice("ab") for _ in range(r.randint(1, 25))] for _ in range(4)]
        automaton = Automaton(shard)
        names = {}
        for sequence in [*shard, [r.choice("abc") for _ in range(30)]]:
            for end, state in enumerate(automaton.matches(sequence, 5), 1):
                window = tuple(sequence[end - 5 : end]) if end >= 5 else None
                inside = window is not None and any(tuple(s[i : i + 5]) == window for s in shard for i in range(len(s) - 4))
                assert (state >= 0) == inside
                if inside:
                    assert names.setdefault(window, state) == state
        assert len(set(names.values())) == len(names)


def near_copies(seed, groups=6):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = sentence(300 + g, r.randint(20, 200)).split()
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "most_tiles": 2, "depth": 2, "tile": 3}])
def test_near_duplicates_match_all_pairs(spark, options):
    texts = awkward() + near_copies(7)
    found = ngram_join.near_duplicates(frame(spark, texts), **options).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == plain_links(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_kept_rows_keep_their_columns_whatever_these_are_called(spark):
    names = ("gone", "of", "row", "place", "_dropped", "_id", "_position", "_rejected", "text_sha256", "kept", "Gone1")
    docs = frame(spark, ["x y", "x y", "z"]).drop("row", "kept").selectExpr("*", *[f"7 as {c}" for c in names])
    for kept in (exact_dedup.keep_one(docs), ngram_join.keep_one(docs)):
        assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"x y", "z"} and kept.count() == 2


def test_near_duplicates_tell_repeated_ids_apart(spark):
    a, b = sentence(41, 60), sentence(42, 60)
    rows = [(1, a), (1, a), (1, b), (2, b + " end"), (None, a + " end"), (None, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.kept) for r in ngram_join.near_duplicates(docs).collect())
    assert found == [(0, 0, 0, True), (0, 1, 2, False), (1, 1, 1, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 1, False)]
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs).collect()) == [(0, "other words here"), (1, a), (1, a), (1, b)]


def test_pivots_reach_every_set_of_a_path(spark):
    sketch = lambda k: np.arange(k % 5, k % 5 + 8, dtype=np.uint32).tobytes()
    big = spark.createDataFrame([(p, 0, 100 * p + k, sketch(k), n) for p, n in ((1, 23), (2, 5), (3, 8)) for k in range(n)], "path long, run int, key long, sketch binary, sets long")
    found = ngram_join.against_pivot(big, 4).collect()
    assert sorted(r.key for r in found) == sorted(r.key for r in big.collect())
    assert all(len({r.pivot for r in found if r.path == p}) == 1 for p in (1, 2, 3))
    both = lambda r: 8 - abs(r.key % 100 % 5 - r.pivot % 100 % 5)
    assert all(r.overlap == pytest.approx(both(r) / (16 - both(r))) for r in found)


def test_recall_is_estimated_from_the_runs_that_found_a_set(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long, run int")
    assert ngram_join.missed(edges([(1, 2, r) for r in range(6)] + [(3, 4, -1)])) == 0
    assert ngram_join.missed(edges([(1, 2, 0), (3, 4, 1), (5, 6, 0), (5, 6, 1)])) == pytest.approx(4 / 10)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + 2 * i, 102 + 2 * i) for i in range(30)] + [(7, 7), (500, 500)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7), part_edges=9).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(41)} | {100 + 2 * i: 100 for i in range(31)}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long").repartition(7), max_rounds=1, part_edges=9)


def test_near_duplicates_edges(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    found = ngram_join.near_duplicates(frame(spark, [None, "", " "])).collect()
    assert all(r.kept and r.n_links == 0 and r.class_id == r.doc_id for r in found)
