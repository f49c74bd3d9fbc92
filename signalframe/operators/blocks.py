"""Long series in blocks, so that no task needs a whole one."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isfinite, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Each row in its block of `size` indices and, as a halo row, in the neighbours that see it within before / after.

    The index must be dense. Windows partitioned by (series, block) then equal windows over the series wherever halo is false.
    """
    own = F.floor(F.col(index) / size)
    first = F.floor((F.col(index) - after) / size)
    last = F.floor((F.col(index) + before) / size)
    rows = df.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return rows.withColumn("halo", F.col("block") != own)


def moving_window(df: DataFrame, keys: list[str], index: str, before: int, after: int, columns: dict[str, tuple], size: int = 100_000) -> DataFrame:
    """Add columns name -> (aggregate of a Column, its input) over rows index - before .. index + after of each series.

    Blocks with halo rows: at most size + before + after rows of a series meet in one window partition.
    """
    w = Window.partitionBy(*keys, "block").orderBy(index).rowsBetween(-before, after)
    rows = with_halo(df, index, size, before, after)
    return rows.withColumns({name: f(c).over(w) for name, (f, c) in columns.items()}).where(~F.col("halo")).drop("block", "halo")


def neighbours(df: DataFrame, keys: list[str], index: str, columns: dict[str, tuple[str, int]], size: int = 100_000) -> DataFrame:
    """Add columns name -> (column, offset): the value `offset` rows later (earlier where negative) in the series, null beyond its ends. The index is dense."""
    before, after = max(0, *[-o for _, o in columns.values()]), max(0, *[o for _, o in columns.values()])
    w = Window.partitionBy(*keys, "block").orderBy(index)
    rows = with_halo(df, index, size, before, after)
    return rows.withColumns({name: F.lead(c, o).over(w) if o >= 0 else F.lag(c, -o).over(w) for name, (c, o) in columns.items()}).where(~F.col("halo")).drop("block", "halo")


def numbered(df: DataFrame, keys: list[str], order: str, out: str, span: float) -> DataFrame:
    """Number the rows of each series from 0 by a number column without ties: within slices of `span` of it, which start where the counts of those before end."""
    rows = df.withColumn("_slice", F.floor(F.col(order) / span))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)) - 1
    return rows.withColumn("_in", inside).join(starts, [*keys, "_slice"]).withColumn(out, F.col("_from") + F.col("_in")).drop("_in", "_from", "_slice")


def last_so_far(df: DataFrame, keys: list[str], index: str, columns: dict[str, Column], size: int = 100_000) -> DataFrame:
    """Add columns name -> the last non-null value of a Column up to each row: within its block, else the last one that earlier blocks carry over."""
    rows = df.withColumn("_block", F.floor(F.col(index) / size)).withColumns(columns)
    inside = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(index))).alias(f"_{c}") for c in columns])
    ends = ends.select(*keys, "_block", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).join(ends, [*keys, "_block"])
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_block", *[f"_{c}" for c in columns])


def exponential_mean(df: DataFrame, keys: list[str], index: str, value: str, alpha: float, out: str, size: int = 100_000, seed: Column | None = None) -> DataFrame:
    """Add y = (1 - alpha) * the y before + alpha * value, from `seed` (a Column with one value a series; as a rule its first value) before the first row.

    Sorted rows go through Python in batches of many series, not in a group a series. Only full blocks carry a y into the next one: their last y is a
    sum of values whose weights fade, so it takes few rows of a block and none of a series shorter than one; it travels as a row before
    the block's first. Null values are errors; the index is dense.
    """
    kinds, decay = dict(df.dtypes), 1 - alpha
    names, schema = [*keys, "_block"], ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    first = F.col(value) if seed is None else seed
    rows = df.withColumns({"_block": F.floor(F.col(index) / size), "_i": F.col(index).cast("long"), "_x": F.col(value).cast("double"), "_seed": first.cast("double")})
    kept = [c for c in df.columns if c != out]

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        held, state = [], table.column("_seed")[0].as_py()
        for y, n in zip(table.column("_last").to_pylist(), table.column("_rows").to_pylist(), strict=True):
            state = y + (decay**n * state if isfinite(state) else state)
            held.append(state)
        return table.select([*keys, "_block"]).append_column("_held", pa.array(held, pa.float64()))

    def place(batch: pa.RecordBatch, row: int) -> str:
        return repr([batch.column(c)[row].as_py() for c in names])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, carry = 0.0, -1, None
        for batch in batches:
            y = []
            columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_i", "_x", "_seed", "_held")]
            data = batch.column("_held").is_null()
            for row, (i, x, start, held, own) in enumerate(zip(*columns, data.to_pylist(), strict=True)):
                if own:
                    if (i % size == 0 or i != last + 1 or carry) and (carry is None or carry != place(batch, row)):
                        state = start
                    state, carry = decay * state + alpha * x, None
                else:
                    state, carry = held, place(batch, row)
                last = i
                y.append(state)
            table = batch.select(kept).append_column(out, pa.array(y, pa.float64()))
            yield table.filter(data)

    # Weights beyond `far` rows are 0 in double precision; values that are not finite count from everywhere.
    far = size if abs(decay) >= 1 else 1 if decay == 0 else min(size, ceil(-1075 / log2(abs(decay))))
    x, end = F.col("_x"), (F.col("_block") + 1) * size - 1
    finite = (F.abs(x) < float("inf")) & ~F.isnan(x)
    weight = F.pow(F.lit(decay), (end - F.col("_i")).cast("double"))
    near = rows.where((end - F.col("_i") < far) | ~finite)
    ends = near.groupBy(*names).agg(F.sum(F.when(finite, alpha * x * weight).otherwise(alpha * x)).alias("_last"), F.count("*").alias("_rows"), F.max("_i").alias("_i"), F.min_by("_seed", "_i").alias("_seed"))
    ends = ends.where(F.col("_i") == end).drop("_i").groupBy(*keys).applyInArrow(carried, f"{schema + ', ' if keys else ''}_block long, _held double")
    ends = ends.withColumn("_block", F.col("_block") + 1).withColumn("_i", F.col("_block") * size - 1)
    every = rows.unionByName(ends, allowMissingColumns=True).repartition(*names).sortWithinPartitions(*names, "_i")
    return every.mapInArrow(along, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{out}` double"]))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, slices: int = 64) -> DataFrame:
    """The first n rows of each key. Slices of a key are cut to n rows before they meet, so a hot key is no problem."""
    part = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
    cut = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).where(F.col("_n") <= n)
    again = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("_n", F.row_number().over(again)).where(F.col("_n") <= n).drop("_n", "_slice")


def cumulative(df: DataFrame, keys: list[str], index: str, value: str, out: str, size: int = 100_000) -> DataFrame:
    """Running sum of value along a series: sums within blocks, then each block starts at the total of those before."""
    rows = df.withColumn("_block", F.floor(F.col(index) / size))
    inside = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_t")).withColumn("_from", F.coalesce(F.sum("_t").over(before), F.lit(0.0))).drop("_t")
    return rows.withColumn("_in", F.sum(value).over(inside)).join(totals, [*keys, "_block"]).withColumn(out, F.col("_in") + F.col("_from")).drop("_in", "_from", "_block")


def percentiles(df: DataFrame, keys: list[str], columns: list[str], shares: list[float], parts: int = 256) -> DataFrame:
    """Exact percentiles for few groups of any size: keys, and of each column an array with the value of each share (null where all are null).

    Values are counted first. Approximate quantiles cut each group's values into about `parts` buckets; the buckets' counts tell
    which ones hold the wanted ranks, and only the values in these are ordered. The cuts need not be good for the result
    to be exact. Both joins are with a few rows a group, so they become broadcast joins where these are small when run.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    names = [*[f"_k{i}" for i in range(len(keys))], "m"]
    counts = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=False)], cells.alias("c")).select(*names[:-1], "c.*")
    counts = counts.where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("n"))

    def beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        other = right.select(*[F.col(c).alias(f"_r{c}" if c in on else c) for c in right.columns])
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
        return left.join(other, same).drop(*[f"_r{c}" for c in on])

    counts = counts.where("n > 0")  # true of all; keeps n where only v is read, so that one exchange of the counts serves all readers
    cuts = counts.groupBy(*names).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    placed = beside(counts, cuts, names).select(*names, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))
    whole = Window.partitionBy(*names)
    sizes = placed.groupBy(*names, "bucket").agg(F.sum("n").alias("rows"))
    sizes = sizes.withColumns({"total": F.sum("rows").over(whole), "first": F.sum("rows").over(whole.orderBy("bucket")) - F.col("rows")})
    places = [(F.col("total") - 1) * F.lit(float(q)) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    wanted = sizes.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("rows")))).where(F.size("ranks") > 0)
    rows = beside(placed, wanted.drop("rows"), [*names, "bucket"])
    start = F.col("first") + F.sum("n").over(Window.partitionBy(*names, "bucket").orderBy("v")) - F.col("n")
    rows = rows.withColumn("start", start).withColumn("rank", F.explode(F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))))
    found = rows.groupBy(*names).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    at = lambda r: F.element_at("at", r)
    values = [F.when(F.floor(x) == F.ceil(x), at(F.floor(x))).otherwise((F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x))) for x in places]
    found = found.withColumn("values", F.array(*values))
    return found.groupBy(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=False)]).agg(*[F.first(F.when(F.col("m") == i, F.col("values")), ignorenulls=True).alias(c) for i, c in enumerate(columns)])


def previous(df: DataFrame, keys: list[str], index: str, out: str, size: int = 100_000) -> DataFrame:
    """The index of the row before, within each key: within its block, else the largest of the last block before that has rows."""
    rows = df.withColumn("_block", F.floor(F.col(index) / size))
    before = rows.groupBy(*keys, "_block").agg(F.max(index).alias("_last"))
    before = before.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
    inside = F.lag(index).over(Window.partitionBy(*keys, "_block").orderBy(index))
    return rows.withColumn("_in", inside).join(before, [*keys, "_block"]).withColumn(out, F.coalesce("_in", "_last")).drop("_in", "_last", "_block")
