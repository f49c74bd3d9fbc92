"""Personal data: overlapping candidates scored by boosted trees, in DataFrame expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import materialize
from signalframe.llm.spans import SPAN, listed, with_apart, with_hits, with_spans

DIGIT = "text rlike '[0-9]'"
LOCAL = "A-Za-z0-9._%+-"
#: Fixed patterns, written so that each is found in time linear in the text; (rank, condition, pattern).
KINDS = {
    "email": (0, "contains(text, '@')", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (1, f"contains(text, '.') and {DIGIT}", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (2, DIGIT, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"),
    "phone": (3, "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
    # High-recall generators of the method. Their candidates may overlap each other and the fixed kinds.
    "mail_like": (4, "contains(text, '@') or text rlike '(?i)[\\\\[(]at[\\\\])]'", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++\x20?(?:@|(?i:\(at\)|\[at\]))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?i:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+"),
    "digits_like": (5, DIGIT, r"(?<![0-9A-Za-z.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){7,}+"),
}
BASE = ("email", "ip", "card", "phone")
GENERATORS = ("mail_like", "digits_like")
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}"
CONTEXT = r"(?i)mail|contact|phone|tel|call|mobile|fax|card|visa|credit|account|\bip\b|host|address"

#: The features of a candidate; each is a small integer, so there are few cells and the trees are exact over them.
FEATURES = ("like", "digits", "groups", "before", "after", "dots", "letters")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    figures = F.transform(F.split(F.reverse(digits_of(value)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    count = F.length(digits_of(value))
    return {"email": F.lit(True), "ip": value.rlike(IP), "card": count.between(14, 19) & luhn(value), "phone": count.between(10, 15)}[kind]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, one array of valid spans for each fixed kind, their sorted union base, and the scored candidates like.

    like has every generator candidate with its features, whether a valid base span lies over it (hit), and whether the
    24 characters before it name a kind of personal data (named). A candidate that goes on in a word is none.
    """
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", KINDS, GENERATORS).drop("text")
    found = found.withColumns({k: F.filter(k, partial(valid, k)) for k in BASE})
    found = found.withColumns({"base": F.array_sort(F.concat(*BASE)), "_all": F.concat(*GENERATORS)})
    found = with_hits(found, "_all", "base", "_hits")

    def features(s: Column, hit: Column) -> Column:
        value = s["value"]
        place = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9A-Za-z]"), 2).otherwise(3)
        return F.struct(
            F.struct(*[s[f].alias(f) for f in ("start", "end", "rank", "kind", "value")]).alias("span"),
            hit.alias("hit"),
            (s["rank"] - len(BASE)).alias("like"),
            F.least(F.length(digits_of(value)), F.lit(20)).alias("digits"),
            F.least(F.size(F.split(value, r"[\x20().-]+", -1)), F.lit(7)).alias("groups"),
            place(F.right(s["before"], F.lit(1))).alias("before"),
            place(s["after"]).alias("after"),
            s["before"].rlike(CONTEXT).alias("named"),
            F.least(F.length(F.regexp_replace(value, r"[^.]", "")), F.lit(3)).alias("dots"),
            value.rlike("[A-Za-z]").cast("int").alias("letters"),
        )

    return found.select("doc_id", *BASE, "base", F.filter(F.zip_with("_all", "_hits", features), lambda c: c["after"] != 2).alias("like"))


def cells(found: DataFrame) -> list[dict]:
    """Of each combination of features, candidates and how many of them are named (hits).

    n and hits are of the training half of the rows, held_n and held_hits of those of the calibration half that no base
    span touches, sure_n and sure_hits of those of the training half over which a base span lies.
    All candidates count. There are at most 2 * 21 * 8 * 4 * 4 * 4 * 2 combinations, whatever the number of rows.
    """
    each = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("held"), F.explode("like").alias("c"))
    parts = {"": F.col("held") == 0, "held_": (F.col("held") == 1) & ~F.col("c.hit"), "sure_": (F.col("held") == 0) & F.col("c.hit")}
    counts = each.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
        *[F.count_if(here & more).alias(f"{part}{name}") for part, here in parts.items() for name, more in (("n", F.lit(True)), ("hits", F.col("c.named")))]
    )
    return sorted((r.asDict() for r in counts.collect()), key=lambda r: [r[f] for f in FEATURES])


def boost(rows: Sequence[dict], trees: int = 20, rate: float = 0.5) -> list[tuple]:
    """Depth-two trees (feature, cut, low, high), low and high being (feature, cut, value, value), by logistic boosting.

    rows are feature cells with n candidates, of which hits are positive; every split and every leaf is a Newton step.
    """
    score = [0.0] * len(rows)
    model = []

    def gain(part: list[int]) -> tuple[float, float]:
        g = sum(rows[i]["hits"] - rows[i]["n"] * prob[i] for i in part)
        h = sum(rows[i]["n"] * prob[i] * (1 - prob[i]) for i in part) + 1.0
        return g * g / h, g / h

    def split(part: list[int]) -> tuple:
        best = (-1.0, FEATURES[0], -1)
        for f in FEATURES:
            for cut in sorted({rows[i][f] for i in part})[:-1] or [-1]:
                sides = [i for i in part if rows[i][f] <= cut], [i for i in part if rows[i][f] > cut]
                best = max(best, (gain(sides[0])[0] + gain(sides[1])[0], f, cut))
        return best[1:]

    for _ in range(trees):
        prob = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        everything = list(range(len(rows)))
        f, cut = split(everything)
        tree = [f, cut]
        for side in ([i for i in everything if rows[i][f] <= cut], [i for i in everything if rows[i][f] > cut]):
            g, at = split(side)
            leaves = [[i for i in side if (rows[i][g] > at) == up] for up in (False, True)]
            steps = [rate * gain(leaf)[1] for leaf in leaves]
            tree.append((g, at, *steps))
            for leaf, step in zip(leaves, steps, strict=True):
                for i in leaf:
                    score[i] += step
        model.append(tuple(tree))
    return model


def scores(model: Sequence[tuple], row) -> float | Column:
    """Sum of the trees for a feature cell (dict) or, as one expression, for a candidate Column."""
    total = F.lit(0.0) if isinstance(row, Column) else 0.0
    for f, cut, *sides in model:
        if isinstance(row, Column):
            low, high = (F.when(row[g] <= at, F.lit(a)).otherwise(F.lit(b)) for g, at, a, b in sides)
            total = total + F.when(row[f] <= cut, low).otherwise(high)
        else:
            g, at, a, b = sides[row[f] > cut]
            total += a if row[g] <= at else b
    return total


def named_share(rows: Sequence[dict]) -> float:
    """How often true personal data is named before: the share among the candidates under base spans; 1 without any."""
    n = sum(r["sure_n"] for r in rows)
    return max(sum(r["sure_hits"] for r in rows), 1) / n if n else 1.0


def threshold(model: Sequence[tuple], rows: Sequence[dict], precision: float, least: int) -> float:
    """The lowest score from which the held-out candidates, from the top down, have the wanted precision; inf if none has.

    Only some true ones are named, and nothing else tends to be, so their number is estimated as hits / named_share.
    """
    best, n, hits = math.inf, 0, 0
    share = named_share(rows)
    for score, total, good in sorted(((scores(model, r), r["held_n"], r["held_hits"]) for r in rows), reverse=True):
        n, hits = n + total, hits + good
        if n >= least and hits >= precision * share * n:
            best = score
    return best


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95, least: int = 20, trees: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Valid matches of the fixed patterns are the base spans and always stay. High-recall generators propose further,
    overlapping candidates (kinds mail_like and digits_like); trees boosted on the format of all candidates of the corpus
    and the characters around them score them. Their weak label, which no base rule decides, is whether the words just
    before name a kind of personal data. The threshold is calibrated on the half of the rows that the trees have not seen
    (see threshold), and a candidate above it that no base span touches joins the spans; of overlapping ones the one that
    starts first does. If no threshold reaches the precision over `least` candidates, only base spans remain.

    A null text counts as empty: no spans. Rows that repeat an id are searched each by itself; a null id is an id like
    others. Empty input gives no rows. Only the named columns are read.
    """
    found = materialize(candidates(docs, id_col, text_col))
    rows = cells(found)
    model = boost([r for r in rows if r["n"]], trees) if any(r["n"] for r in rows) else []
    least_score = threshold(model, rows, precision, least) if model else math.inf
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    extra = none if least_score == math.inf else F.transform(F.filter("like", lambda c: ~c["hit"] & (scores(model, c) >= F.lit(least_score))), lambda c: c["span"])
    return with_apart(found.withColumn("_added", extra), "_added", "_extra").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "_extra"))).alias("spans"),
    )
