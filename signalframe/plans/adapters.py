"""The driver's tables in the shapes that the operators take, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked points of one recording: frame, t, point_id, x, y, dx, dy, jump_px, fb_error, status."""
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # serves the window and what groups by frame after it
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    rows = rows.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return rows.select(
        F.col("l_orderkey").alias("frame"),
        (F.col("l_orderkey") / 200).alias("t"),
        F.col("l_linenumber").alias("point_id"),
        (F.col("l_extendedprice") / 100).alias("x"),
        F.col("l_quantity").alias("y"),
        (F.col("l_discount") + 0.0).alias("dx"),
        (F.col("l_tax") + 0.0).alias("dy"),
        F.hypot("l_discount", "l_tax").alias("jump_px"),
        (F.col("l_discount") * 10 + 0.0).alias("fb_error"),
        (F.col("l_returnflag") != "R").cast("int").alias("status"),
    )


POINTS = """points AS (
  SELECT l_orderkey AS frame, l_orderkey / 200.0::DOUBLE AS t, l_linenumber AS point_id, l_extendedprice / 100 AS x, l_quantity AS y,
         l_discount + 0.0::DOUBLE AS dx, l_tax + 0.0::DOUBLE AS dy, sqrt(l_discount * l_discount + l_tax * l_tax) AS jump_px, l_discount * 10 + 0.0::DOUBLE AS fb_error,
         (l_returnflag <> 'R')::INT AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS rn FROM lineitem)
  WHERE rn = 1)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor series: source_id, axis, idx (from 0 by time), t in hours, value."""
    rows = table(spark, sf_dir, "events").where("ts is not null and value is not null")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("axis"), (F.row_number().over(order) - 1).alias("idx"), hours.alias("t"), "value")


SIGNALS = """signals AS (
  SELECT user_id AS source_id, event_type AS axis, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx,
         date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9::DOUBLE AS t, value
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector objects: frame, object_id, class_id, score, x, y, w, h, area."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("frame"),
        F.col("o_orderkey").alias("object_id"),
        F.col("o_orderpriority").alias("class_id"),
        (price / 500000).alias("score"),
        (F.col("o_orderkey") % 1900).alias("x"),
        (F.col("o_orderkey") % 1060).alias("y"),
        (20 + F.col("o_orderkey") % 181).alias("w"),
        (4 + F.col("o_orderkey") % 87).alias("h"),
        F.round((20 + F.col("o_orderkey") % 181) * (4 + F.col("o_orderkey") % 87) * (0.2 + 0.8 * price / 500000), 3).alias("area"),
    )


DETECTIONS = """detections AS (
  SELECT o_custkey AS frame, o_orderkey AS object_id, o_orderpriority AS class_id, o_totalprice / 500000 AS score, o_orderkey % 1900 AS x, o_orderkey % 1060 AS y,
         20 + o_orderkey % 181 AS w, 4 + o_orderkey % 87 AS h,
         round((20 + o_orderkey % 181) * (4 + o_orderkey % 87) * (0.2::DOUBLE + 0.8::DOUBLE * o_totalprice / 500000), 3) AS area
  FROM orders)"""


def pixels(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Gray frames of 8 x 8 pixels: frame, class_id, px, y, x, v (0..255).

    Dealt frames are spread before their pixels are taken out, over a stated number of tasks, as Spark would judge them by their few bytes.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("class_id"), "embedding")
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")  # serves what groups by frame after it
    rows = rows.select("frame", "class_id", F.posexplode("embedding").alias("px", "e"))
    gray = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("e").cast("double") + 0.5) * 255)))
    return rows.select("frame", "class_id", F.col("px").cast("long").alias("px"), F.floor(F.col("px") / 8).alias("y"), (F.col("px") % 8).cast("long").alias("x"), gray.cast("long").alias("v"), (F.col("e") > 0).alias("on"))


PIXELS = """pixels AS (
  SELECT frame, class_id, px, px // 8 AS y, px % 8 AS x, floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (e::DOUBLE + 0.5::DOUBLE) * 255)))::BIGINT AS v, e > 0 AS "on"
  FROM (SELECT vec_id AS frame, label AS class_id, unnest(range(len(embedding))) AS px, unnest(embedding) AS e FROM embeddings))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate runs: method, video_id, path, observed, successful, points, expected."""
    rows = table(spark, sf_dir, "lineitem")
    good = F.col("l_discount") <= 0.05
    found = rows.groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("video_id"), F.col("l_linestatus").alias("path")).agg(
        F.count_distinct("l_orderkey").alias("observed"), F.count_distinct(F.when(good, F.col("l_orderkey"))).alias("successful"), F.count("*").alias("points")
    )
    return found.withColumn("expected", 90 + F.col("video_id") % 20)


RUNS = """runs AS (
  SELECT l_returnflag AS method, l_suppkey AS video_id, l_linestatus AS path, count(DISTINCT l_orderkey) AS observed,
         count(DISTINCT CASE WHEN l_discount <= 0.05 THEN l_orderkey END) AS successful, count(*) AS points, 90 + l_suppkey % 20 AS expected
  FROM lineitem GROUP BY 1, 2, 3)"""
