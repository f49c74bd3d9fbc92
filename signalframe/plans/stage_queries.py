"""Queries of colour modes, fitted masks, envelopes on common points, and series through stages by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.operators import aligning, colours, filters, masks, series, stages
from signalframe.plans.adapters import PIXELS, SIGNALS, pixels, signals, table
from signalframe.plans.point_queries import rounded
from signalframe.sources import tables

SPAN = 48.0  # hours


def coloured(spark, sf):
    rows = pixels(spark, sf, dealt=True)
    return rows.select("frame", "px", "y", "x", *[((F.col("v") * k) % 256).alias(c) for c, k in zip("rgb", (1, 2, 3), strict=True)])


def pixel_colour_modes(spark, sf):
    rows = colours.by_mode(coloured(spark, sf))
    return rounded(rows.groupBy("frame", "mode").agg(F.avg("v").alias("mean_v"), F.min("v").alias("low"), F.max("v").alias("high")), 6)


MEASURES = ("mean_bed_edge_y", "std_bed_edge_y", "mean_temporal_iou")


def colour_modes_compared(spark, sf):
    rows = colours.by_mode(coloured(spark, sf))
    rows = rows.select("frame", F.col("mode").alias("configuration"), "px", "y", "x", "v")
    edges = masks.edge_rows(rows, 3.5, 2.0, by=["configuration"])
    edges = edges.groupBy("configuration").agg(F.avg("edge").alias("mean_bed_edge_y"), F.stddev_pop("edge").alias("std_bed_edge_y")).unpivot("configuration", list(MEASURES[:2]), "metric", "value")
    overlaps = masks.temporal_overlap(rows.where("px = 0").select("frame", "configuration").distinct(), rows.where("v > 127"), ["configuration"], ["configuration"])
    overlaps = overlaps.select("configuration", F.lit(MEASURES[2]).alias("metric"), F.col("mean_iou").alias("value"))
    return rounded(colours.configurations(edges.unionByName(overlaps), colours.MODES, MEASURES), 6)


def mask_fitted(spark, sf):
    rows = pixels(spark, sf)
    side = 4 + 3 * (F.col("frame") % 4)
    sizes = rows.select("frame").distinct().select("frame", F.lit(8).alias("height"), F.lit(8).alias("width"), side.alias("to_height"), (side + (F.col("frame") % 5 == 4).cast("int")).alias("to_width"))
    fit, unlike = masks.fitted(rows.select("frame", "y", "x", F.col("on").cast("int").alias("value")), sizes, ["frame"])
    place = F.col("y") * 64 + F.col("x")
    fit = fit.groupBy("frame").agg(F.lit("fitted").alias("status"), F.count("*").alias("n"), F.count_if("on").alias("n_on"), F.sum(F.when(F.col("on"), place).otherwise(0)).alias("places"))
    none = F.lit(0).cast("long")
    return fit.unionByName(unlike.select("frame", F.lit("other aspect").alias("status"), none.alias("n"), none.alias("n_on"), none.alias("places")))


def envelope_agreement(spark, sf):
    rows = filters.mean_at_time(signals(spark, sf).withColumn("value", F.abs("value")), series.KEYS, "t", "value")
    side = lambda axis: rows.where(F.col("axis") == axis).select("source_id", "t", "value")
    return rounded(aligning.envelope_agreement(side("click"), side("view"), ["source_id"], SPAN), 4)


def series_staged(spark, sf):
    rows = stages.run(signals(spark, sf), ["detrend", ("zscore", {"out": "z"}), "minmax", ("decimate", {"every": 3})], alpha=0.5)
    return rounded(rows.select(*series.KEYS, "idx", "t", "value", "z", "unit"), 4)


def signal_loaded(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("kind"), "value")
    return rounded(tables.to_signal(spark, rows, "load").groupBy("axis").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("t").alias("mean_t"), F.avg("value").alias("mean_value")), 4)


def hue(r="r", g="g", b="b"):
    top, span = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    turn = f"CASE WHEN {top} = {r} THEN 30.0::DOUBLE * ({g} - {b}) / {span} WHEN {top} = {g} THEN 60 + 30.0::DOUBLE * ({b} - {r}) / {span} ELSE 120 + 30.0::DOUBLE * ({r} - {g}) / {span} END"
    return f"CASE WHEN {span} > 0 THEN (floor({turn} + 0.5::DOUBLE)::BIGINT + 180) % 180 ELSE 0 END"


MODES = f"""{PIXELS}, c AS (SELECT frame, px, y, x, v AS r, v * 2 % 256 AS g, v * 3 % 256 AS b FROM pixels),
  m AS (SELECT frame, px, y, x, unnest(['gray', 'r', 'g', 'b', 'hsv_h', 'hsv_s', 'hsv_v']) AS mode, unnest(range(7)) AS place,
    unnest([floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::BIGINT, r, g, b, {hue()},
      CASE WHEN greatest(r, g, b) > 0 THEN floor(255.0::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) + 0.5::DOUBLE)::BIGINT ELSE 0 END, greatest(r, g, b)]) AS v FROM c)"""

QUERIES = {
    "pixel_colour_modes": (pixel_colour_modes, f"WITH {MODES} SELECT frame, mode, round(avg(v), 6) AS mean_v, min(v) AS low, max(v) AS high FROM m GROUP BY 1, 2"),
    "colour_modes_compared": (colour_modes_compared, f"""WITH {MODES}, s AS (SELECT place, mode, frame, y, abs(lead(v) OVER w - lag(v) OVER w) / 2 AS d FROM m WINDOW w AS (PARTITION BY mode, frame, x ORDER BY y)),
        p AS (SELECT place, mode, frame, y, avg(d) * exp(-0.5::DOUBLE * ((y - 3.5::DOUBLE) / 2)^2) AS s FROM s WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4),
        q AS (SELECT place, mode, frame, y, avg(s) OVER (PARTITION BY mode, frame ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM p), e AS (SELECT place, mode, frame, arg_max(y, (round(s, 6), -y)) AS edge FROM q GROUP BY ALL),
        f AS (SELECT mode, frame, list(px) FILTER (v > 127) AS px FROM m GROUP BY 1, 2), n AS (SELECT a.mode, list_distinct(list_concat(coalesce(a.px, []), coalesce(b.px, []))) AS u, list_intersect(coalesce(a.px, []), coalesce(b.px, [])) AS i FROM f a JOIN f b ON b.mode = a.mode AND b.frame = a.frame + 1),
        o AS (SELECT mode, avg(CASE WHEN len(u) = 0 THEN 1.0::DOUBLE ELSE len(i) / len(u) END) AS iou FROM n GROUP BY 1),
        r AS (SELECT place::INT AS place, mode AS configuration, avg(edge) AS mean_bed_edge_y, stddev_pop(edge) AS std_bed_edge_y, max(iou) AS mean_temporal_iou FROM e LEFT JOIN o USING (mode) GROUP BY 1, 2)
        SELECT place, configuration, {', '.join(f'round({c}, 6) + 0.0 AS {c}, round({c} - (SELECT {c} FROM r WHERE place = 0), 6) + 0.0 AS {c}_difference' for c in MEASURES)} FROM r"""),
    "mask_fitted": (mask_fitted, f"""WITH {PIXELS}, s AS (SELECT DISTINCT frame, 4 + 3 * (frame % 4) AS h, 4 + 3 * (frame % 4) + (frame % 5 = 4)::INT AS w FROM pixels),
        g AS (SELECT frame, h, w, unnest(range(h * h)) AS i FROM s WHERE h = w), t AS (SELECT frame, i // h AS ty, i % h AS tx, (i // h) * 8 // h AS y, (i % h) * 8 // h AS x FROM g)
        SELECT frame, 'fitted' AS status, count(*) AS n, count(*) FILTER ("on") AS n_on, sum(CASE WHEN "on" THEN ty * 64 + tx ELSE 0 END)::BIGINT AS places FROM t JOIN pixels USING (frame, y, x) GROUP BY 1
        UNION ALL SELECT frame, 'other aspect', 0, 0, 0 FROM s WHERE h <> w"""),
    "envelope_agreement": (envelope_agreement, f"""WITH {SIGNALS}, v AS (SELECT source_id, axis, t, avg(abs(value)) AS value FROM signals GROUP BY 1, 2, 3), s AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY source_id, axis ORDER BY t)),
        e AS (SELECT source_id, axis, min(t) AS a, max(t) AS b, count(*) AS n FROM v GROUP BY 1, 2), c AS (SELECT source_id, greatest(l.a, r.a) AS a, least(l.b, r.b) AS b, greatest(50, least(l.n, r.n)) - 1 AS last FROM (SELECT * FROM e WHERE axis = 'click') l JOIN (SELECT * FROM e WHERE axis = 'view') r USING (source_id)),
        k AS (SELECT source_id, a, b, last, unnest(range(last + 1)) AS k FROM c WHERE b > a), g AS (SELECT source_id, k, CASE WHEN k = last THEN b ELSE least(b, a + k * ((b - a) / last)) END AS t FROM k),
        i AS (SELECT g.source_id, axis, k, CASE WHEN s.t = g.t THEN value ELSE value + (g.t - s.t) / (t2 - s.t) * (v2 - value) END AS x FROM g JOIN s ON s.source_id = g.source_id AND s.axis IN ('click', 'view') AND s.t <= g.t AND (g.t < s.t2 OR s.t = g.t)),
        m AS (SELECT source_id, axis, count(*) AS n, max(x) AS top FROM i GROUP BY 1, 2), q AS (SELECT source_id, axis, max(top) AS top, quantile_cont(x, 0.5) FILTER (k + 1 <= greatest(3, round_even(0.05::DOUBLE * n, 0))) AS scale FROM i JOIN m USING (source_id, axis) GROUP BY 1, 2),
        z AS (SELECT source_id, axis, k, x / CASE WHEN scale > 2.220446049250313e-16::DOUBLE THEN scale WHEN top > 2.220446049250313e-16::DOUBLE THEN top END AS z FROM i JOIN q USING (source_id, axis)),
        p AS (SELECT source_id, k, l.z AS a, r.z AS b, l.z - r.z AS e FROM (SELECT * FROM z WHERE axis = 'click') l JOIN (SELECT * FROM z WHERE axis = 'view') r USING (source_id, k)), d AS (SELECT *, lead(e) OVER (PARTITION BY source_id ORDER BY k) AS f FROM p)
        SELECT source_id, count(*) AS n, round(CASE WHEN stddev_pop(a) > 2.3e-16::DOUBLE AND stddev_pop(b) > 2.3e-16::DOUBLE THEN corr(a, b) END, 4) + 0.0 AS correlation, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
          round(CASE WHEN stddev_pop(e) FILTER (f IS NOT NULL) > 2.3e-16::DOUBLE AND stddev_pop(f) > 2.3e-16::DOUBLE THEN corr(e, f) END, 4) + 0.0 AS residual_lag1 FROM d GROUP BY 1"""),
    "series_staged": (series_staged, f"""WITH {SIGNALS}, m AS (SELECT source_id, axis, regr_slope(value, t) AS s, regr_intercept(value, t) AS i, max(abs(value)) AS v, max(abs(t)) AS u FROM signals GROUP BY 1, 2), d AS (SELECT source_id, axis, idx, t, CASE WHEN abs(value - s * t - i) <= 1e-12::DOUBLE * (v + abs(s) * u) THEN 0 ELSE value - s * t - i END AS value FROM signals JOIN m USING (source_id, axis)),
        w AS (SELECT source_id, axis, avg(value) AS m, stddev_pop(value) AS s, min(value) AS a, max(value) AS b FROM d GROUP BY 1, 2)
        SELECT source_id, axis, idx, round(t, 4) AS t, round(value, 4) + 0.0 AS value, round(CASE WHEN s > 0 THEN (value - m) / s ELSE value END, 4) + 0.0 AS z, round(CASE WHEN b > a THEN (value - a) / (b - a) ELSE value END, 4) + 0.0 AS unit FROM d JOIN w USING (source_id, axis) WHERE idx % 3 = 0"""),
    "signal_loaded": (signal_loaded, """WITH f AS (SELECT min(ts) AS first FROM events), s AS (SELECT date_diff('microsecond', first, ts) / 1e6::DOUBLE AS t, value FROM events, f WHERE ts IS NOT NULL AND isfinite(value))
        SELECT 'load' AS axis, count(*) AS n, round(min(t), 4) AS first_t, round(max(t), 4) AS last_t, round(avg(t), 4) AS mean_t, round(avg(value), 4) AS mean_value FROM s"""),
}
