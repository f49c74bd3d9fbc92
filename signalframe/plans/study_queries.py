"""Queries of the smaller studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.operators import series, studies
from signalframe.plans.adapters import DETECTIONS, PIXELS, POINTS, SIGNALS, detections, pixels, points, signals, table
from signalframe.plans.archive_queries import INVENTORY, archive
from signalframe.plans.point_queries import rounded
from signalframe.plans.series_queries import W


def regions(spark, sf):
    rows = points(spark, sf).withColumn("frame", F.floor(F.col("frame") / 200))
    return studies.by_region(rows, spark.createDataFrame([("left", 0.0, 300.0), ("middle", 200.0, 700.0), ("right", 700.0, 2000.0)], "roi string, x_from double, x_to double"))


def region_flow(spark, sf):
    return rounded(regions(spark, sf), 9)


def region_cumulative(spark, sf):
    return rounded(studies.accumulated(regions(spark, sf)).select("frame", "roi", "cum_dx", "cum_dy"), 6)


def region_summary(spark, sf):
    return rounded(studies.region_summary(studies.accumulated(regions(spark, sf))), 6)


def run_times(spark, sf):
    return rounded(studies.runtimes(signals(spark, sf), "value", ["axis"]), 6)


def frame_runtimes_once(spark, sf):
    rows = signals(spark, sf).withColumn("frame", F.floor("t"))
    once = rows.groupBy("axis", "frame").agg(F.min_by("value", F.struct("t", "source_id")).alias("value"))
    return rounded(studies.runtimes(once, "value", ["axis"]), 6)


def series_damping(spark, sf):
    return rounded(studies.damping(series.local_maxima(signals(spark, sf))), 5)


def series_decay_ratio(spark, sf):
    return rounded(studies.decay_ratio(signals(spark, sf)), 6)


def series_downsampled(spark, sf):
    return rounded(studies.downsampled(signals(spark, sf), [1, 2, 3]), 6)


def frame_first_gain(spark, sf):
    rows = pixels(spark, sf).groupBy("class_id", "frame").agg(F.avg("v").alias("brightness"))
    return rounded(studies.first_frame_gain(rows, ["class_id"], "frame", "brightness"), 6)


def polygon_areas(spark, sf):
    rows = table(spark, sf, "embeddings")
    part = lambda first: F.transform(F.sequence(F.lit(first), F.lit(first + 14), F.lit(2)), lambda i: (F.element_at("embedding", i).cast("double") + 0.5) * 2000)
    return rounded(rows.select(F.col("vec_id").alias("frame"), studies.polygon_area(part(1), part(2), 1920, 1080).alias("area")), 3)


def pixel_gray(spark, sf):
    rows = pixels(spark, sf).select("frame", "px", *[((F.col("v") * k) % 256).alias(c) for c, k in zip("rgb", (1, 2, 3))])
    return rounded(rows.groupBy("frame").agg(F.avg(studies.gray(*[F.col(c) for c in "rgb"])).alias("gray"), F.avg(F.greatest("r", "g", "b")).alias("hsv_value")), 10)


def mask_rescaled(spark, sf):
    return studies.rescaled(pixels(spark, sf).select("frame", "y", "x", "on"), 8, 4)


def metric_kinds(spark, sf):
    rows = archive(spark, sf).unpivot(["source_id", "axis"], ["rms", "std", "rate", "duration"], "metric", "value").where("value is not null")
    return rounded(rows.groupBy(studies.metric_kind(F.col("metric")).alias("kind")).agg(F.count("*").alias("n"), F.max("value").alias("top")), 6)


def tracking_metrics(spark, sf):
    tracks = detections(spark, sf).select(F.col("frame").alias("t"), F.concat_ws("/", F.col("class_id"), F.col("frame") % 20).alias("track_id"), "object_id", "x", "y")
    return rounded(studies.tracking(tracks, 50.0), 6)


def tracks_per_frame(spark, sf):
    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"))
    return rounded(studies.tracks_per_frame(frames, detections(spark, sf).select("frame", F.col("class_id").alias("track_id"))), 6)


REGIONS = f"""WITH {POINTS}, r AS (SELECT * FROM (VALUES ('left', 0.0, 300.0), ('middle', 200.0, 700.0), ('right', 700.0, 2000.0)) v(roi, x_from, x_to)),
  f AS (SELECT frame // 200 AS frame, roi, avg(dx) AS mean_dx, avg(dy) AS mean_dy, quantile_cont(dx, 0.5) AS med_dx, avg(sqrt(dx * dx + dy * dy)) AS mean_m, quantile_cont(sqrt(dx * dx + dy * dy), 0.5) AS med_m, max(sqrt(dx * dx + dy * dy)) AS max_m, count(*) AS n
    FROM points JOIN r ON x >= x_from AND x < x_to GROUP BY 1, 2),
  c AS (SELECT *, sum(mean_dx) OVER w AS cum_dx, sum(mean_dy) OVER w AS cum_dy FROM f WINDOW w AS (PARTITION BY roi ORDER BY frame))"""
PEAKS = f"WITH {SIGNALS}, n AS (SELECT *, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM signals {W}), p AS (SELECT *, lead(t) OVER q AS t2, lead(value) OVER q AS v2 FROM n WHERE value > lo AND value >= hi AND value > 0 WINDOW q AS (PARTITION BY source_id, axis ORDER BY t))"
RUNTIMES = "axis, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(1 / avg(value), 6) AS fps"
XS = ", ".join(f"least(greatest(round((embedding[{i}]::DOUBLE + 0.5) * 2000), 0), 1919)" for i in range(1, 16, 2))
YS = ", ".join(f"least(greatest(round((embedding[{i}]::DOUBLE + 0.5) * 2000), 0), 1079)" for i in range(2, 17, 2))
SHOELACE = " + ".join(f"x[{i}] * y[{i % 8 + 1}] - x[{i % 8 + 1}] * y[{i}]" for i in range(1, 9))

QUERIES = {
    "region_flow": (region_flow, f"{REGIONS} SELECT frame, roi, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in ('mean_dx', 'mean_dy', 'med_dx', 'mean_m', 'med_m', 'max_m'))}, n FROM f"),
    "region_cumulative": (region_cumulative, f"{REGIONS} SELECT frame, roi, round(cum_dx, 6) AS cum_dx, round(cum_dy, 6) AS cum_dy FROM c"),
    "region_summary": (region_summary, f"""{REGIONS}, u AS (UNPIVOT (SELECT roi, mean_dx, mean_dy, mean_m, cum_dx, cum_dy FROM c) ON mean_dx, mean_dy, mean_m, cum_dx, cum_dy INTO NAME signal VALUE value)
        SELECT roi, signal, round((max(value) - min(value)) / 2, 6) AS amplitude, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean FROM u GROUP BY 1, 2"""),
    "run_times": (run_times, f"WITH {SIGNALS} SELECT {RUNTIMES} FROM signals GROUP BY 1"),
    "frame_runtimes_once": (frame_runtimes_once, f"WITH {SIGNALS}, o AS (SELECT axis, floor(t)::BIGINT AS frame, arg_min(value, (t, source_id)) AS value FROM signals GROUP BY 1, 2) SELECT {RUNTIMES} FROM o GROUP BY 1"),
    "series_damping": (series_damping, f"""{PEAKS}, d AS (SELECT source_id, axis, count(*) AS n, quantile_cont(t2 - t, 0.5) AS period, quantile_cont(ln(value / v2), 0.5) AS decrement FROM p WHERE t2 IS NOT NULL GROUP BY 1, 2)
        SELECT source_id, axis, n, round(period, 5) AS period, round(decrement, 5) + 0.0 AS decrement, round(1 / period, 5) AS frequency, round(decrement / sqrt(4 * pi() * pi() + decrement * decrement), 5) + 0.0 AS ratio FROM d"""),
    "series_decay_ratio": (series_decay_ratio, f"""WITH {SIGNALS}, n AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY source_id, axis) * 0.05::DOUBLE)) AS part, count(*) OVER (PARTITION BY source_id, axis) AS n FROM signals),
        d AS (SELECT source_id, axis, quantile_cont(value, 0.5) FILTER (idx < part) AS start, quantile_cont(value, 0.5) FILTER (idx >= n - part) AS "end" FROM n GROUP BY 1, 2)
        SELECT source_id, axis, round(start, 6) AS start, round("end", 6) AS "end", round(CASE WHEN start <> 0 THEN "end" / start END, 6) AS ratio, "end" < start AS decaying FROM d"""),
    "series_downsampled": (series_downsampled, f"""WITH {SIGNALS}, d AS (SELECT source_id, axis, factor, count(*) AS n, max(t) - min(t) AS span, (quantile_cont(value, 0.95) - quantile_cont(value, 0.05)) / 2 AS amplitude FROM signals, (SELECT unnest([1, 2, 3])::INT AS factor) WHERE idx % factor = 0 GROUP BY 1, 2, 3),
        e AS (SELECT *, CASE WHEN span > 0 THEN (n - 1) / span END AS rate, max(CASE WHEN factor = 1 THEN amplitude END) OVER (PARTITION BY source_id, axis) AS ref FROM d)
        SELECT source_id, axis, factor, n, round(span, 6) AS span, round(rate, 6) AS rate, round(amplitude, 6) AS amplitude, round(rate / 2, 6) AS nyquist, round(CASE WHEN ref > 0 THEN 100 * amplitude / ref END, 6) AS kept_amplitude FROM e"""),
    "frame_first_gain": (frame_first_gain, f"""WITH {PIXELS}, b AS (SELECT class_id, frame, avg(v) AS brightness FROM pixels GROUP BY 1, 2)
        SELECT class_id, frame, round(brightness, 6) AS brightness, round(CASE WHEN brightness > 0 THEN first_value(brightness) OVER (PARTITION BY class_id ORDER BY frame) / brightness ELSE 1 END, 6) AS gain FROM b"""),
    "polygon_areas": (polygon_areas, f"WITH p AS (SELECT vec_id AS frame, [{XS}] AS x, [{YS}] AS y FROM embeddings) SELECT frame, round(abs({SHOELACE}) / 2, 3) AS area FROM p"),
    "pixel_gray": (pixel_gray, f"WITH {PIXELS}, c AS (SELECT frame, v AS r, v * 2 % 256 AS g, v * 3 % 256 AS b FROM pixels) SELECT frame, round(avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 10) AS gray, round(avg(greatest(r, g, b)), 10) AS hsv_value FROM c GROUP BY 1"),
    "mask_rescaled": (mask_rescaled, f'WITH {PIXELS} SELECT frame, y // 2 AS y, x // 2 AS x, "on" FROM pixels WHERE y % 2 = 1 AND x % 2 = 1'),
    "tracking_metrics": (tracking_metrics, f"""WITH {DETECTIONS}, d AS (SELECT concat(class_id, '/', frame % 20) AS track_id, sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2) AS step FROM detections WINDOW w AS (PARTITION BY concat(class_id, '/', frame % 20) ORDER BY frame, object_id)),
        t AS (SELECT track_id, count(*) AS n, count(step) AS steps, count(CASE WHEN step > 50 THEN 1 END) AS jumps FROM d GROUP BY 1)
        SELECT count(*) AS tracks, round(avg(n), 6) AS mean_length, sum(jumps)::BIGINT AS jumps, round(sum(jumps) / sum(steps), 6) AS jump_ratio FROM t"""),
    "tracks_per_frame": (tracks_per_frame, f"""WITH {DETECTIONS}, f AS (SELECT c_custkey AS frame, coalesce(n, 0) AS n, coalesce(o, 0) AS o FROM customer LEFT JOIN (SELECT frame, count(DISTINCT class_id) AS n, count(*) AS o FROM detections GROUP BY 1) d ON d.frame = c_custkey)
        SELECT count(*) AS frames, round(avg(n), 6) AS mean_tracks, max(n) AS most_tracks, sum(o)::BIGINT AS observations FROM f"""),
    "metric_kinds": (metric_kinds, f"""WITH {SIGNALS}, {INVENTORY}, u AS (SELECT unnest(['rms', 'std', 'rate', 'duration']) AS metric, unnest([rms, std, rate, duration]) AS value FROM inventory)
        SELECT CASE WHEN metric = 'std' THEN 'error' WHEN metric = 'rate' THEN 'coverage' ELSE 'other' END AS kind, count(*) AS n, round(max(value), 6) AS top FROM u WHERE value IS NOT NULL GROUP BY 1"""),
}
