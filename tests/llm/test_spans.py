import random
import re
import time

import pytest
from pyspark.sql import functions as F

from signalframe.llm import pii, secret_scan
from signalframe.llm.spans import SPAN, with_apart, with_hits, with_running, with_spans


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_values(spark, n):
    values = [random.Random(n).randrange(-50, 50) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    for op, f in (("+", lambda a, b: a + b), ("max", max)):
        running = [0]
        for v in values:
            running.append(f(running[-1], v))
        assert with_running(df, "v", op, "r").first().r == running[1:]
        assert with_running(df, "v", op, "r", exclusive=True).first().r == running[:-1]


def test_places_context_hits_and_apart_match_plain_loops(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["abc@d ", "é", " ", "77.", "xyz", "@@@", "q@w"]) for _ in range(r.randrange(400))) for _ in range(20)] + ["", None, "q@w" * 300]
    pattern = r"[a-z]+@[a-z]+"
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = with_spans(df, "text", {"one": (1, "text is not null", pattern), "two": (2, "contains(text, '7')", r"7[7.]+")}, ("one",))
    for row in found.collect():
        text = row.text or ""
        ones = list(re.finditer(pattern, text))
        assert [(s.start, s.end, s.rank, s.kind, s.value) for s in row.one] == [(m.start(), m.end(), 1, "one", m.group()) for m in ones]
        assert [(s.before, s.after) for s in row.one] == [(text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 1]) for m in ones]
        assert [(s.start, s.end) for s in row.two] == [m.span() for m in re.finditer(r"7[7.]+", text)]

    def spans(n, longest):
        return sorted({(a := r.randrange(900), a + r.randrange(1, longest), r.randrange(4)) for _ in range(n)})

    rows = [(spans(300, 12), spans(200, 9)), ([], spans(3, 9)), (spans(3, 9), []), ([], [])]
    full = lambda x: [(a, b, k, "k", "v") for a, b, k in x]
    pairs = spark.createDataFrame([(i, full(a), full(b)) for i, (a, b) in enumerate(rows)], f"i int, a array<{SPAN}>, b array<{SPAN}>")
    for row in with_apart(with_hits(pairs, "a", "b", "h"), "a", "kept").collect():
        a, b = rows[row.i]
        assert row.h == [any(y[0] < x[1] and x[0] < y[1] for y in b) for x in a]
        order = lambda s: (s[0], -s[1], s[2])
        want = [x for x in sorted(a, key=order) if not any(y[0] < x[1] and x[0] < y[1] and order(y) < order(x) for y in a)]
        assert [(s.start, s.end, s.rank) for s in row.kept] == want


@pytest.mark.parametrize("unit, kind", [("ab.c{}@example.org ", "email"), ("{:06d}; 4111 1111 1111 1111, ", "card"), ("token=Abcdef{:08d}xyz\n", "assign")])
def test_a_megabyte_of_matches(spark, unit, kind):
    parts = [unit.format(i) for i in range(1_000_000 // len(unit.format(10_000)))]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text, "s"), (2, "mail ab@cd.ef", "t")], "doc_id long, text string, source string").coalesce(1)
    assert len(text) > 900_000
    for operator in (pii.find_pii, secret_scan.secret_scan):
        operator(df.where("doc_id = 2")).collect()
        began = time.perf_counter()
        row = operator(df).where("doc_id = 1").first()
        assert time.perf_counter() - began < 40  # in the square of the matches it was hours
        if f"n_{kind}" in row:
            assert row[f"n_{kind}"] == len(parts)
            spans = [s.split(":") for s in row.spans.split(",")]
            places = [(int(s[1]), int(s[2])) for s in spans if s[0] == kind]
            assert places == sorted(places) and places[-1][1] <= len(text) and len(places) == len(parts)
