"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; only a local session that names none, as in tests, gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/signalframe-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables whose readers have all been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(name for n in count() if (name := f"{stem}{n or ''}") not in taken)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, rows_per_group: int, out: str, n_rows: int | None = None, top: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without a task that sees a whole key.

    Rows of a key are dealt by `spread` to as many slices as leave about rows_per_group rows in each;
    a slice is numbered by itself and starts where the counts of the slices before it end.
    The slice counts are one small row each, so only they are summed up in the order of a key.
    With top, `spread` holds numbers from 0 to top and slices are ranges of it, so where `order` begins with it, ranks follow order throughout.
    """
    n_rows = df.count() if n_rows is None else n_rows
    slices = max(1, -(-n_rows // rows_per_group))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)) if top is None else F.floor(spread / (top + 1) * slices))
    own = Window.partitionBy(*keys, "_slice")
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = cut.withColumn("_in_slice", F.row_number().over(own.orderBy(*order)) - 1)
    return numbered.join(starts, same).withColumn(out, F.col("_from") + F.col("_in_slice")).drop("_slice", "_s", "_from", "_in_slice", *[f"_k{i}" for i in range(len(keys))])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, b < a, no more than one for each node of a partition: union-find within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            at = x
            while parent[at] != at:
                at = parent[at]
            while parent[x] != at:
                parent[x], x = at, parent[x]
            return at

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        moved = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_pydict({"a": pa.array(moved, pa.int64()), "b": pa.array([root(x) for x in moved], pa.int64())})

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 64, part_edges: int = 500_000) -> DataFrame:
    """Connected components of edges (a, b) of longs: one row (node, component) for each node, component its smallest node.

    Parts of about part_edges edges are contracted to stars first. Where these are not disjoint, alternating large-star and small-star
    steps follow, each one a grouping by node whose result is written to the shared folder; the number of rounds is
    logarithmic in the longest path. Nothing is collected. Edges from a node to itself count for nothing. No end within
    max_rounds is an error. The result is a materialized table.
    """
    now = materialize(contracted(edges.where("a <> b").coalesce(1 + edges.count() // part_edges)))
    for _ in range(max_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root")).where("ups + root > 1").isEmpty():
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, materialize(new.where("a <> b"))
        discard(before)
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
    discard(now)
    return out
