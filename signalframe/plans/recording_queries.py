"""Queries over recordings: annotated shapes, segmentation signals, common grids, trackers and running metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.operators import extraction, masks, series, studies
from signalframe.plans.adapters import DETECTIONS, PIXELS, SIGNALS, detections, pixels, signals, table
from signalframe.plans.point_queries import rounded
from signalframe.plans.series_queries import GRID, STEP, grid
from signalframe.streaming import trackers

FACTORS = [1, 2, 4]


def annotation_counts(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") / 10).cast("long").alias("frame"), "event_type", F.from_json("props", "k int").alias("p"))
    suffix = F.when(F.col("p.k") % 3 == 0, "_inner_pipe").when(F.col("p.k") % 3 == 1, "_particle_bed").otherwise("_other")
    shapes = rows.select("frame", F.concat("event_type", suffix).alias("label"), (F.col("p.k") % 7).alias("points"))
    return extraction.shape_counts(shapes, F.col("points"), ["frame"])


def pair_common_grid(spark, sf):
    return rounded(series.common_grid(signals(spark, sf), "click", "view"), 5)


def segmentation_signals(spark, sf):
    rows = detections(spark, sf).select((F.col("frame") % 50).alias("video"), F.floor(F.col("frame") / 50).alias("frame"), "class_id", "x", "y")
    mean = lambda column, kind: F.avg(F.when(F.col("class_id") == kind, F.col(column)))
    wide = rows.groupBy("video", "frame").agg(mean("x", "1-URGENT").alias("inner_pipe_center_x"), mean("y", "1-URGENT").alias("inner_pipe_center_y"), mean("y", "5-LOW").alias("bed_edge_y"))
    return rounded(studies.signal_summary(wide, ["video"], "frame"), 5)


def series_downsampled_dominant(spark, sf):
    return rounded(studies.downsampled_dominant(grid(spark, sf), FACTORS, STEP), 6)


def bed_edge_metrics(spark, sf):
    return rounded(studies.edge_metrics(signals(spark, sf), series.KEYS, "idx", "value"), 9)


def mask_temporal(spark, sf):
    rows = pixels(spark, sf)
    return rounded(masks.temporal_overlap(rows.select("frame", "class_id").distinct(), rows.where("on"), ["class_id"]), 6)


def found(spark, sf):
    return detections(spark, sf).select("class_id", "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "area")


def tracks_single(spark, sf):
    return rounded(trackers.track(found(spark, sf), ["class_id"], trackers.Single), 4)


def tracks_multi(spark, sf):
    return rounded(trackers.track(found(spark, sf), ["class_id"], trackers.Multi), 4)


def values(spark, sf):
    return signals(spark, sf).select("source_id", "axis", F.col("idx").alias("frame"), F.col("value").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("area"))


def values_smoothed(spark, sf):
    return rounded(trackers.track(values(spark, sf), series.KEYS, trackers.Smoother).select("source_id", "axis", "frame", F.col("x").alias("value")), 5)


def values_deflickered(spark, sf):
    return rounded(trackers.track(values(spark, sf), series.KEYS, trackers.Deflicker).select("source_id", "axis", "frame", F.col("x").alias("gain"), F.col("y").alias("flicker")), 5)


def run_metrics(spark, sf):
    rows = signals(spark, sf).select(F.col("source_id").alias("run_id"), F.col("value").alias("seconds"), F.col("idx").alias("tracks"))
    return rounded(trackers.running_metrics(rows), 9)


def segments_sliding(spark, sf):
    rows = table(spark, sf, "events").where("ts is not null and value is not null").select(F.col("user_id").alias("source_id"), "ts", "value")
    return rounded(trackers.sliding_segments(rows, "48 hours", "24 hours").withColumn("start", F.col("start").cast("timestamp_ntz")), 9)


# Spectra of whole series with a periodic Hann window, by hand: x is centred, i counts from 0 and n is the number of samples.
SPECTRA = """c AS (SELECT {keys}, k - min(k) OVER s AS i, count(*) OVER s AS n, value - avg(value) OVER s AS x FROM {source} WINDOW s AS (PARTITION BY {keys})),
  b AS (SELECT {keys}, n, bin, i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / n)) AS wx, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / n) AS w
    FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS bin FROM c WHERE n >= 3)),
  a AS (SELECT {keys}, n, bin, sqrt(sum(wx * cos(2 * pi() * ((bin * i) % n) / n)) ** 2 + sum(wx * sin(2 * pi() * ((bin * i) % n) / n)) ** 2) / sum(w) * CASE WHEN 2 * bin = n THEN 1 ELSE 2 END AS amplitude
    FROM b GROUP BY {keys}, n, bin),
  d AS (SELECT {keys}, n, arg_max(bin, (round(amplitude, 9), -bin)) / n AS frequency FROM a WHERE bin > 0 GROUP BY {keys}, n)"""

QUERIES = {
    "annotation_counts": (annotation_counts, """WITH s AS (SELECT event_id // 10 AS frame, (props->>'k')::INT AS k FROM events), l AS (SELECT frame, CASE k % 3 WHEN 0 THEN 'inner_pipe' WHEN 1 THEN 'particle_bed' END AS kind, k % 7 >= 3 AS enough FROM s)
      SELECT frame, count(*) FILTER (kind = 'inner_pipe' AND enough) AS inner_pipe_shapes, count(*) FILTER (kind = 'particle_bed' AND enough) AS particle_bed_shapes, count(*) FILTER (kind IS NOT NULL AND NOT enough) AS short_shapes,
      count(*) FILTER (kind IS NULL) AS ignored_labels, false AS empty FROM l GROUP BY 1"""),
    "pair_common_grid": (pair_common_grid, f"""WITH {SIGNALS}, r AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM signals WHERE axis IN ('click', 'view') WINDOW w AS (PARTITION BY source_id, axis ORDER BY idx)),
      s AS (SELECT source_id, axis, min(t) AS s, max(t) AS e, quantile_cont(t2 - t, 0.5) FILTER (t2 - t > 0) AS step FROM r GROUP BY 1, 2),
      g AS (SELECT *, floor((e - s) * rate)::BIGINT AS top FROM (SELECT source_id, max(s) AS s, min(e) AS e, 1 / max(step) AS rate, count(step) AS sides FROM s GROUP BY 1) WHERE sides = 2),
      p AS (SELECT r.source_id, axis, t, t2, value, v2, s, rate, unnest(range(greatest(ceil((t - s) * rate)::BIGINT, 0), least(CASE WHEN t2 >= e THEN floor((t2 - s) * rate)::BIGINT ELSE ceil((t2 - s) * rate)::BIGINT - 1 END, top) + 1)) AS k
        FROM r JOIN g ON r.source_id = g.source_id WHERE t2 > t AND t < e AND top >= 2),
      v AS (SELECT source_id, axis, k, s + k / rate AS moment, value + (s + k / rate - t) / (t2 - t) * (v2 - value) AS value FROM p)
      SELECT * FROM (SELECT source_id, k, round(max(moment), 5) AS t, round(max(value) FILTER (axis = 'click'), 5) AS a, round(max(value) FILTER (axis = 'view'), 5) AS b FROM v GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "segmentation_signals": (segmentation_signals, f"""WITH {DETECTIONS}, wide AS (SELECT frame % 50 AS video, frame // 50 AS frame, avg(x) FILTER (class_id = '1-URGENT') AS inner_pipe_center_x, avg(y) FILTER (class_id = '1-URGENT') AS inner_pipe_center_y,
        avg(y) FILTER (class_id = '5-LOW') AS bed_edge_y FROM detections GROUP BY 1, 2),
      u AS (UNPIVOT wide ON inner_pipe_center_x, inner_pipe_center_y, bed_edge_y INTO NAME signal VALUE v),
      l AS (SELECT video, signal, frame, v - first_value(v) OVER (PARTITION BY video, signal ORDER BY frame) AS value FROM u),
      q AS (SELECT *, lead(frame) OVER w AS f2, lead(value) OVER w AS v2 FROM l WINDOW w AS (PARTITION BY video, signal ORDER BY frame)),
      grid AS (SELECT video, signal, k, value + (k - frame) / (f2 - frame) * (v2 - value) AS value FROM (SELECT *, unnest(range(frame, f2)) AS k FROM q WHERE f2 IS NOT NULL)),
      {SPECTRA.format(keys='video, signal', source='grid')}
      SELECT m.video, m.signal, m.n, round(amplitude, 5) AS amplitude, round(rms, 5) AS rms, round(frequency, 5) AS dominant
      FROM (SELECT video, signal, count(*) AS n, (max(value) - min(value)) / 2 AS amplitude, sqrt(avg(value * value)) AS rms FROM l GROUP BY 1, 2) m LEFT JOIN d ON m.video = d.video AND m.signal = d.signal"""),
    "series_downsampled_dominant": (series_downsampled_dominant, f"""WITH {SIGNALS}, {GRID}, f AS (SELECT source_id, axis, factor, k // factor AS k, value FROM grid, (VALUES (1), (2), (4)) t(factor) WHERE k % factor = 0),
      {SPECTRA.format(keys='source_id, axis, factor', source='f')},
      o AS (SELECT source_id, axis, factor, n, 1 / ({STEP}::DOUBLE * factor) AS rate, frequency / ({STEP}::DOUBLE * factor) AS dominant FROM d)
      SELECT source_id, axis, factor, n, round(rate, 6) AS rate, round(rate / 2, 6) AS nyquist, round(rate / n, 6) AS resolution, round(dominant, 6) AS dominant,
      round(dominant - max(CASE WHEN factor = 1 THEN dominant END) OVER (PARTITION BY source_id, axis), 6) AS difference FROM o"""),
    "bed_edge_metrics": (bed_edge_metrics, f"""WITH {SIGNALS}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY source_id, axis ORDER BY idx)) AS step FROM signals)
      SELECT source_id, axis, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) FILTER (step > 20) AS jumps FROM d GROUP BY 1, 2"""),
    "mask_temporal": (mask_temporal, f"""WITH {PIXELS}, s AS (SELECT frame, class_id, list(px) FILTER ("on") AS px FROM pixels GROUP BY 1, 2),
      o AS (SELECT a.class_id, CASE WHEN len(list_distinct(list_concat(coalesce(a.px, []), coalesce(b.px, [])))) = 0 THEN 1.0::DOUBLE
        ELSE len(list_intersect(coalesce(a.px, []), coalesce(b.px, []))) / len(list_distinct(list_concat(coalesce(a.px, []), coalesce(b.px, [])))) END AS iou FROM s a JOIN s b ON b.frame = a.frame + 1)
      SELECT class_id, count(*) AS pairs, round(avg(iou), 6) AS mean_iou, round(stddev_pop(iou), 6) AS std_iou FROM o GROUP BY 1"""),
    "tracks_single": (tracks_single, f"""WITH RECURSIVE {DETECTIONS}, best AS (SELECT class_id, frame, arg_max(x::DOUBLE, (area, -x, -y)) AS x, arg_max(y::DOUBLE, (area, -x, -y)) AS y FROM detections GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY frame) AS i FROM best),
      k AS (SELECT class_id, frame, i, x AS sx, 0.0::DOUBLE AS vx, y AS sy, 0.0::DOUBLE AS vy, 10.0::DOUBLE AS p, 0.0::DOUBLE AS c, 10.0::DOUBLE AS q FROM o WHERE i = 1
        UNION ALL SELECT o.class_id, o.frame, o.i, k.sx + k.vx + (k.p + 2 * k.c + k.q + 0.01::DOUBLE) / g.s * (o.x - k.sx - k.vx), k.vx + (k.c + k.q) / g.s * (o.x - k.sx - k.vx),
          k.sy + k.vy + (k.p + 2 * k.c + k.q + 0.01::DOUBLE) / g.s * (o.y - k.sy - k.vy), k.vy + (k.c + k.q) / g.s * (o.y - k.sy - k.vy),
          (1 - (k.p + 2 * k.c + k.q + 0.01::DOUBLE) / g.s) * (k.p + 2 * k.c + k.q + 0.01::DOUBLE), (1 - (k.p + 2 * k.c + k.q + 0.01::DOUBLE) / g.s) * (k.c + k.q), k.q + 0.01::DOUBLE - (k.c + k.q) * (k.c + k.q) / g.s
        FROM k JOIN o ON o.class_id = k.class_id AND o.i = k.i + 1, LATERAL (SELECT k.p + 2 * k.c + k.q + 5.01::DOUBLE AS s) g)
      SELECT class_id, frame, 1::BIGINT AS track_id, round(sx, 4) AS x, round(sy, 4) AS y, 0::BIGINT AS missed FROM k"""),
    "tracks_multi": (tracks_multi, None),
    "values_smoothed": (values_smoothed, f"""WITH RECURSIVE {SIGNALS}, m AS (SELECT source_id, axis, idx, quantile_cont(value, 0.5) OVER (PARTITION BY source_id, axis ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med FROM signals),
      e AS (SELECT source_id, axis, idx, med AS value FROM m WHERE idx = 0 UNION ALL SELECT m.source_id, m.axis, m.idx, 0.8::DOUBLE * e.value + 0.2::DOUBLE * m.med FROM e JOIN m ON m.source_id = e.source_id AND m.axis = e.axis AND m.idx = e.idx + 1)
      SELECT source_id, axis, idx AS frame, round(value, 5) AS value FROM e"""),
    "values_deflickered": (values_deflickered, None),
    "run_metrics": (run_metrics, f"WITH {SIGNALS} SELECT source_id AS run_id, count(*) AS frames, round(avg(value), 9) AS mean_seconds, round(CASE WHEN avg(value) > 0 THEN 1 / avg(value) END, 9) AS fps, max(idx) AS most_tracks FROM signals GROUP BY 1"),
    "segments_sliding": (segments_sliding, """WITH w AS (SELECT user_id AS source_id, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
      SELECT source_id, start, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM w GROUP BY 1, 2"""),
}
