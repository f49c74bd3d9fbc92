"""Places of pattern matches in texts, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each span: code points, end exclusive.
SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"


#: The 24 code points before and the one after a span.
CONTEXT = f"{SPAN[:-1]},before:string,after:string>"
#: Elements of the pieces in which running values are computed.
PIECE = 128


def with_running(df: DataFrame, values: str, op: str, out: str, exclusive: bool = False) -> DataFrame:
    """Add the running sums (op "+") or maxima from 0 on ("max") of the array column of integers `values`, without an element's own value if exclusive.

    Pieces of PIECE elements are summed up, the sums give what each piece starts from, and arrays grow by one within a piece only, so
    that a long array takes time in proportion to its length, but for the square of its number of pieces. Columns that a loop reads are named
    twice, which keeps Spark from computing them anew in every step.
    """
    join = (lambda x, y: f"{x} + {y}") if op == "+" else (lambda x, y: f"greatest({x}, {y})")
    grown = f"(a, v) -> concat(a, array({join('element_at(a, -1)', 'v')}))"
    piece = f"slice({values}, c * {PIECE} + 1, {PIECE})"
    rows = df.withColumn("_sums", F.expr(f"transform(sequence(0, greatest(size({values}) - 1, 0) div {PIECE}), c -> aggregate({piece}, 0, (x, v) -> {join('x', 'v')}))"))
    rows = rows.withColumn("_starts", F.expr(f"aggregate(_sums, array(0), {grown})"))
    inside = f"aggregate({piece}, array(_starts[int(c)]), {grown})"
    rows = rows.withColumn(out, F.expr(f"flatten(transform(sequence(0, size(_starts) - 2), c -> slice({inside}, {1 if exclusive else 2}, least({PIECE}, greatest(size({values}) - int(c) * {PIECE}, 0)))))"))
    return rows.drop("_sums", "_starts")


def with_spans(df: DataFrame, text: str, kinds: dict[str, tuple[int, str, str]], context: tuple[str, ...] = ()) -> DataFrame:
    """Add for each kind an array column of its leftmost non-overlapping matches as SPANs, or CONTEXTs for the kinds named so.

    kinds: kind -> (rank, SQL condition that every text with a match fulfils, pattern); every match has three code points or more. Splitting at the pattern
    gives what lies between the matches, so the running lengths of gaps and matches are the places and no text is cut by place. A text without
    a match is scanned once, one that fails the condition not at all.
    """
    rows = df.withColumns({f"_m_{k}": F.when(F.expr(need), F.regexp_extract_all(text, F.lit(pattern), 0)) for k, (_, need, pattern) in kinds.items()})
    rows = rows.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, pattern, -1)) for k, (_, _, pattern) in kinds.items()})
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumns({f"_i_{k}": F.when(F.size(f"_m_{k}") > 0, F.sequence(F.lit(0), F.size(f"_m_{k}") - 1)).otherwise(none) for k in kinds})
    rows = rows.withColumns({f"_l_{k}": F.expr(f"transform(_i_{k}, e -> length(_g_{k}[e]) + length(_m_{k}[e]))") for k in kinds})
    for k in kinds:
        rows = with_running(rows, f"_l_{k}", "+", f"_n_{k}")

    def placed(k: str, rank: int) -> str:
        fields = f"'start', _n_{k}[e] - length(_m_{k}[e]), 'end', _n_{k}[e], 'rank', {rank}, 'kind', '{k}', 'value', _m_{k}[e]"
        if k in context:
            pieces = [f"right(coalesce(get(_{x}_{k}, e - {j}), ''), 24)" for j in range(8, 0, -1) for x in "gm"]
            fields += f", 'before', right(concat({', '.join(pieces)}, _g_{k}[e]), 24), 'after', left(concat(left(_g_{k}[e + 1], 1), left(coalesce(get(_m_{k}, e + 1), ''), 1)), 1)"
        return f"transform(_i_{k}, e -> named_struct({fields}))"

    return rows.withColumns({k: F.expr(placed(k, rank)) for k, (rank, _, _) in kinds.items()}).drop(*[f"_{x}_{k}" for k in kinds for x in "mgiln"])


def with_hits(df: DataFrame, spans: str, base: str, out: str) -> DataFrame:
    """Add an array of booleans: whether a span of the array column base lies over each span of the array column spans.

    Both are merged by place, spans by their ends and base by its starts, with the furthest end of base so far.
    """
    events = f"""array_sort(concat(transform({base}, b -> named_struct('at', b.start, 'what', 1, 'far', b.end, 'i', -1)), transform({spans}, (c, i) -> named_struct('at', c.end, 'what', 0, 'far', c.start, 'i', i))))"""
    rows = df.withColumn("_e", F.expr(events)).withColumn("_far", F.expr("transform(_e, e -> if(e.what = 1, e.far, 0))"))
    rows = with_running(rows, "_far", "max", "_run")
    hits = "transform(array_sort(filter(zip_with(_e, _run, (e, r) -> named_struct('i', e.i, 'hit', r > e.far)), h -> h.i >= 0)), h -> h.hit)"
    return rows.withColumn(out, F.expr(hits)).drop("_e", "_far", "_run")


def with_apart(df: DataFrame, spans: str, out: str) -> DataFrame:
    """Add the spans of an array column without those over which an earlier one lies: earlier by start, then longer, then of lower rank; judged on all of them."""
    ordered = f"array_sort({spans}, (a, b) -> case when a.start <> b.start then a.start - b.start when a.end <> b.end then b.end - a.end else a.rank - b.rank end)"
    rows = df.withColumn("_e", F.expr(ordered)).withColumn("_far", F.expr("transform(_e, e -> e.end)"))
    rows = with_running(rows, "_far", "max", "_run", exclusive=True)
    return rows.withColumn(out, F.expr("transform(filter(zip_with(_e, _run, (e, r) -> named_struct('span', e, 'free', r <= e.start)), x -> x.free), x -> x.span)")).drop("_e", "_far", "_run")


def listed(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined; spans must be sorted."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
