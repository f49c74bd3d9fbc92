"""Secret scan with corpus-wide ownership frequencies, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import materialize
from signalframe.llm.spans import SPAN, listed, with_hits, with_spans

#: Fixed patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (0, r"text rlike '(?i)password|passwd|secret|token|api_?key'", ASSIGN),
    "access": (1, "contains(text, 'AKIA')", r"AKIA[A-Z0-9]+"),
    # A run of hex digits matches as a whole, so asking for 32 in the pattern finds the same runs.
    "hex": (2, "text is not null", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    # High-recall formats of the method: bare tokens that mix upper case, lower case and digits.
    "token": (3, "text is not null", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"),
}


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """doc_id, owner, repo and the arrays of spans: base (contract kinds, sorted) and token (the method's own)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    found = with_spans(rows, "text", KINDS)

    def secret(span):
        return F.regexp_extract(span["value"], ASSIGN, 2)

    assign = F.filter("assign", lambda s: F.length(secret(s)) >= 8)
    found = found.select(
        "doc_id", "owner", "repo",
        F.transform(assign, lambda s: s.withField("value", secret(s))).alias("assign"),
        F.filter("access", lambda s: F.length(s["value"]) >= 16).alias("access"), "hex", "token",
    )
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    # A bare token is a candidate of its own only where no base span lies over it.
    free = F.filter(F.zip_with("token", "_hits", lambda t, hit: F.struct(t.alias("span"), hit.alias("hit"))), lambda x: ~x["hit"])
    return with_hits(found, "token", "base", "_hits").withColumn("token", F.transform(free, lambda x: x["span"])).drop("_hits")


def ownership(found: DataFrame) -> DataFrame:
    """Of each candidate value's hash: distinct repositories and owners in the whole corpus, and how often it occurs (n).

    Grouping first by hash, owner and repository collapses a hot value before it moves.
    """
    values = found.select("owner", "repo", F.explode(F.expr("transform(concat(base, token), s -> sha2(s.value, 256))")).alias("hash"))
    once = values.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    return once.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 1, max_repos: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base spans (kinds assign, access, hex) are the fixed patterns' matches and always stay. The method adds bare
    mixed tokens that no base span touches, as kind token, where their value is live: over the whole corpus it
    occurs with at most max_owners owners and max_repos repositories. A value that more have is a widely copied
    example: its bare tokens are not reported, and its base spans count in n_example, not in n_live.

    A null text counts as empty: no spans, and base_sha256 is that of the empty string. Null owners and repositories
    do not count as one. Rows that repeat an id are scanned each by itself. Empty input gives no rows. Of docs only
    the named columns are read, so clashing names of other columns do no harm.
    """
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()))
    has = found.where(F.size("base") + F.size("token") > 0)
    verdicts = materialize(ownership(has).select("hash", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"), "n"))
    each = has.select("row", F.explode(F.concat("base", "token")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    # Fewer than 256 values can have more than one in 256 of the spans each: those are broadcast, so their spans stay where they are.
    hot = F.broadcast(verdicts.where(F.col("n") * 256 > (verdicts.agg(F.sum("n")).first()[0] or 0)).drop("n"))
    rest = each.join(hot.select("hash"), "hash", "left_anti").join(verdicts.drop("n"), "hash")
    judged = each.join(hot, "hash").unionByName(rest).groupBy("row").agg(F.collect_list(F.struct("span", "live")).alias("judged"))
    out = found.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", F.expr(f"cast(array() as array<struct<span:{SPAN},live:boolean>>)")))
    spans = F.expr("array_sort(transform(filter(judged, j -> j.live or j.span.rank < 3), j -> j.span))")
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.expr("cast(size(filter(judged, j -> j.live)) as long)").alias("n_live"),
        F.expr("cast(size(filter(judged, j -> not j.live)) as long)").alias("n_example"),
    )
