"""Queries over archives, candidate runs, detections by frame and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalframe.functions import scalars
from signalframe.operators import masks, matching, ranking
from signalframe.operators.blocks import previous, with_halo
from signalframe.plans.adapters import DETECTIONS, PIXELS, RUNS, SIGNALS, detections, pixels, runs, signals, table
from signalframe.plans.point_queries import rounded


def archive(spark, sf):
    return matching.inventory(signals(spark, sf), ["source_id", "axis"])


AXES = ("click", "error", "purchase", "signup", "view")
INVENTORY = """inventory AS (SELECT source_id, axis, count(*) AS rows, min(t) AS start, max(t) AS "end", stddev_pop(value) AS std, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS peak_to_peak,
  max(t) - min(t) AS duration, 1 / quantile_cont(d, 0.5) FILTER (d > 0) AS rate FROM (SELECT *, t - lag(t) OVER (PARTITION BY source_id, axis ORDER BY t, idx) AS d FROM signals) GROUP BY 1, 2)"""
INTERVALS = """near AS (SELECT * FROM (SELECT source_id, axis, window_id, greatest(0, least("end", window_end) - greatest(start, window_start)) AS overlap, greatest(0, window_start - "end", start - window_end) AS gap
  FROM inventory, (SELECT k AS window_id, k * 90.0::DOUBLE AS window_start, k * 90.0::DOUBLE + 30 AS window_end FROM range(8) r(k))) WHERE gap <= 12)"""

def windows(spark):
    start = F.col("id") * 90.0
    return spark.range(8).select(F.col("id").alias("window_id"), start.alias("window_start"), (start + 30).alias("window_end"))


def near(spark, sf):
    return matching.interval_join(archive(spark, sf), windows(spark), 12.0, 48.0)


def archive_inventory(spark, sf):
    return rounded(archive(spark, sf), 6)


def archive_intervals(spark, sf):
    return rounded(near(spark, sf).select("source_id", "axis", "window_id", "overlap", "gap"), 6)


def archive_top_lists(spark, sf):
    best = archive(spark, sf).orderBy(F.desc_nulls_last("rms"), "source_id", "axis").limit(50)
    w = Window.orderBy(F.desc_nulls_last("rms"), "source_id", "axis")
    rows = best.withColumn("rank", F.row_number().over(w))
    return rounded(rows.select("source_id", "axis", "rank", "rms", (F.col("rank") <= 10).alias("top10"), (F.col("rank") <= 20).alias("top20")), 6)


def archive_best_axis(spark, sf):
    rows = archive(spark, sf).withColumn("error", scalars.relative_error(F.col("rate"), F.lit(0.12)))
    best = rows.where("error is not null").groupBy("source_id").agg(F.min_by("axis", F.struct(F.round("error", 9), "axis")).alias("axis"), F.min("error").alias("error"))
    label = scalars.ladder([(F.col("error") <= 10, "good"), (F.col("error") <= 25, "fair")], "poor")
    return rounded(best.withColumn("verdict", label), 6)


def archive_axes_flagged(spark, sf):
    rows = archive(spark, sf).select("source_id", "axis", scalars.relative_error(F.col("rate"), F.lit(0.12)).alias("error"))
    return rounded(ranking.flag_best(rows, "error", ["source_id"], "axis", 10.0), 6)


def archive_scores(spark, sf):
    rows = archive(spark, sf).select("source_id", "axis", F.col("rate").alias("frequency"), (F.col("std") / F.col("rms")).alias("r")).where("frequency is not null")
    return rounded(matching.scored(rows, 0.12), 6)


def archive_metrics_long(spark, sf):
    return rounded(archive(spark, sf).unpivot(["source_id", "axis"], ["rms", "std", "duration"], "metric", "value"), 6)


def archive_metrics_pivot(spark, sf):
    return rounded(archive(spark, sf).groupBy("source_id").pivot("axis").agg(F.first("rms")), 6)


def runs_canonical(spark, sf):
    return matching.canonical(runs(spark, sf), 0.99)


def runs_coverage(spark, sf):
    return rounded(matching.coverage(runs(spark, sf)), 6)


def runs_methods(spark, sf):
    chosen = matching.canonical(runs(spark, sf), 0.5).where("chosen")
    return rounded(matching.method_summary(matching.coverage(chosen)), 6)


def runs_status(spark, sf):
    rows = runs(spark, sf).join(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("video_id"), F.lit(True).alias("known")), "video_id", "left")
    status = scalars.ladder([(F.col("known").isNull(), "missing_metadata"), (F.col("observed") < 10, "too_short")], "ok")
    return rows.groupBy("method", status.alias("status")).agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def runs_union(spark, sf):
    a = runs(spark, sf).where("path = 'F'").select("method", "video_id", "observed")
    b = runs(spark, sf).where("path = 'O'").select("method", "video_id", "points")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("method").agg(F.count("*").alias("n"), F.count("observed").alias("with_observed"), F.count("points").alias("with_points"))


def videos_compared(spark, sf):
    rows = detections(spark, sf).groupBy((F.col("frame") % 50).alias("video")).agg(F.count("*").alias("n_rows"), F.count_distinct("frame").alias("frames"), F.count_distinct("class_id").alias("tracks"), F.avg("score").alias("score"), F.avg("area").alias("area"))
    return rounded(rows, 6)


def videos_top(spark, sf):
    return videos_compared(spark, sf).orderBy(F.desc("n_rows"), "video").limit(15)


def frame_gaps(spark, sf):
    frames = detections(spark, sf).where("score > 0.7").select("class_id", "frame").distinct()
    gaps = previous(frames, ["class_id"], "frame", "before").withColumn("gap", F.col("frame") - F.col("before")).where("gap is not null")
    return gaps.groupBy("class_id", "gap").agg(F.count("*").alias("n"))


def frame_trails(spark, sf):
    rows = detections(spark, sf).where("score > 0.5")
    trail = Window.partitionBy("class_id", "block").orderBy("frame").rangeBetween(-4, 0)
    counts = with_halo(rows.groupBy("class_id", "frame").agg(F.count("*").alias("n"), F.avg("score").alias("s")), "frame", 100_000, 4, 0)
    return rounded(counts.select("class_id", "frame", "halo", F.sum("n").over(trail).alias("trail"), F.avg("s").over(trail).alias("mean_score")).where(~F.col("halo")).drop("halo"), 6)


def nearest_track(spark, sf):
    rows = detections(spark, sf)
    seg = rows.where("class_id = '1-URGENT'").groupBy("frame").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    d2 = F.round((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2, 6)
    near_by = rows.where("class_id <> '1-URGENT'").join(seg, "frame").withColumn("d2", d2)
    return rounded(near_by.groupBy("frame").agg(F.min_by("object_id", F.struct("d2", "object_id")).alias("object_id"), F.min("d2").alias("d2")), 4)


def first_tracks(spark, sf):
    return detections(spark, sf).groupBy("class_id").agg(F.min("frame").alias("first_frame"), F.min("object_id").alias("first_object")).orderBy("first_frame", "class_id").limit(3)


def chunks(spark, sf):
    return rounded(detections(spark, sf).groupBy(F.floor(F.col("frame") / 100).alias("chunk")).agg(F.count("*").alias("n"), F.min("frame").alias("low"), F.max("frame").alias("high"), F.avg("score").alias("score")), 6)


def mask_brightness(spark, sf):
    return rounded(masks.brightness(pixels(spark, sf)), 6)


def mask_gain(spark, sf):
    rows = masks.with_gain(pixels(spark, sf), 120.0)
    return rounded(rows.groupBy("frame").agg(F.avg("out").alias("mean_out"), F.max("out").alias("max_out"), F.first("gain").alias("gain")), 6)


def mask_histogram(spark, sf):
    return masks.histogram(pixels(spark, sf))


def mask_otsu(spark, sf):
    return rounded(masks.otsu(pixels(spark, sf)), 3)


def mask_equalised(spark, sf):
    return masks.equalised(pixels(spark, sf)).select("frame", "px", "equalised")


def shifted_masks(spark, sf):
    on = pixels(spark, sf).where(F.col("on")).select("frame", "px", "class_id")
    return on, on.withColumn("frame", F.col("frame") - 1)


def mask_overlap(spark, sf):
    truth, predicted = shifted_masks(spark, sf)
    return rounded(masks.overlap_counts(truth, predicted, 64), 6)


def mask_class_summary(spark, sf):
    truth, predicted = shifted_masks(spark, sf)
    scores = masks.overlap_counts(truth, predicted, 64).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("class_id")), "frame")
    return rounded(scores.groupBy("class_id").agg(F.count("*").alias("n"), F.avg("iou").alias("mean"), F.percentile("iou", F.lit(0.5)).alias("median"), F.stddev_pop("iou").alias("std"), F.min("iou").alias("low"), F.max("dice").alias("best_dice")), 6)


def mask_sets(spark, sf):
    truth, predicted = (m.select("frame", "px") for m in shifted_masks(spark, sf))
    both, only = truth.intersect(predicted), truth.exceptAll(predicted)
    count = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    out = count(truth.union(predicted).distinct(), "joined").join(count(both, "shared"), "frame", "left").join(count(only, "lost"), "frame", "left")
    return out.select("frame", "joined", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("lost", F.lit(0)).alias("lost"))


def mask_edges(spark, sf):
    return rounded(masks.edge_rows(pixels(spark, sf), 3.5, 2.0), 4)


def annotations_shapes(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    label = scalars.ladder([(F.col("event_type").endswith("w"), "edge"), (F.col("p.k") > 50, "large")], "ignored")
    counts = [F.count(F.when(label == x, 1)).alias(x) for x in ("edge", "large", "ignored")]
    return rounded(rows.groupBy("event_type").agg(*counts, F.avg("p.k").alias("mean_k")), 6)


ON = 'truth AS (SELECT frame, px FROM pixels WHERE "on"), pred AS (SELECT frame - 1 AS frame, px FROM pixels WHERE "on")'
COUNTS = f"""{ON}, counts AS (SELECT *, 64 - tp - fp - fn AS tn, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS dice,
  CASE WHEN tp + fn > 0 THEN (tp + fp) / (tp + fn) END AS area_ratio FROM (SELECT coalesce(t.frame, p.frame) AS frame, count(CASE WHEN t.px IS NOT NULL AND p.px IS NOT NULL THEN 1 END) AS tp,
  count(CASE WHEN t.px IS NULL THEN 1 END) AS fp, count(CASE WHEN p.px IS NULL THEN 1 END) AS fn FROM truth t FULL JOIN pred p ON t.frame = p.frame AND t.px = p.px GROUP BY 1))"""
A = f"WITH {SIGNALS}, {INVENTORY}"
R = f"WITH {RUNS}"
D = f"WITH {DETECTIONS}"
P = f"WITH {PIXELS}"
CANON = """canon AS (SELECT *, row_number() OVER (PARTITION BY method, video_id ORDER BY full_length DESC, observed DESC, successful DESC, points DESC, path DESC) AS rank, count(*) OVER (PARTITION BY method, video_id) AS candidates
  FROM (SELECT *, observed >= ceil(expected * {share}::DOUBLE) AS full_length FROM runs))"""
PCT = "100.0::DOUBLE * observed / nullif(expected, 0) AS coverage, 100.0::DOUBLE * successful / nullif(observed, 0) AS conditional, 100.0::DOUBLE * successful / nullif(expected, 0) AS effective"

QUERIES = {
    "archive_inventory": (archive_inventory, f"""{A} SELECT source_id, axis, rows, {', '.join(f'round("{c}", 6) AS "{c}"' for c in ('start', 'end', 'std', 'rms', 'peak_to_peak', 'duration', 'rate'))} FROM inventory"""),
    "archive_intervals": (archive_intervals, f"{A}, {INTERVALS} SELECT source_id, axis, window_id, round(overlap, 6) AS overlap, round(gap, 6) AS gap FROM near"),
    "archive_top_lists": (archive_top_lists, f"{A} SELECT source_id, axis, rank, round(rms, 6) AS rms, rank <= 10 AS top10, rank <= 20 AS top20 FROM (SELECT *, row_number() OVER (ORDER BY rms DESC NULLS LAST, source_id, axis) AS rank FROM inventory) WHERE rank <= 50"),
    "archive_best_axis": (archive_best_axis, f"""{A}, e AS (SELECT source_id, axis, 100 * abs(rate - 0.12::DOUBLE) / 0.12::DOUBLE AS error FROM inventory WHERE rate IS NOT NULL) SELECT source_id, arg_min(axis, (round(error, 9), axis)) AS axis, round(min(error), 6) AS error,
        CASE WHEN min(error) <= 10 THEN 'good' WHEN min(error) <= 25 THEN 'fair' ELSE 'poor' END AS verdict FROM e GROUP BY 1"""),
    "archive_axes_flagged": (archive_axes_flagged, f"""{A}, e AS (SELECT source_id, axis, 100 * abs(rate - 0.12::DOUBLE) / 0.12::DOUBLE AS error FROM inventory), b AS (SELECT source_id, arg_min(axis, (round(error, 9), axis)) AS top FROM e WHERE error IS NOT NULL GROUP BY 1)
        SELECT source_id, axis, round(error, 6) AS error, coalesce(axis = top, false) AS best, coalesce(error <= 10, false) AS passed FROM e LEFT JOIN b USING (source_id)"""),
    "archive_scores": (archive_scores, f"""{A}, e AS (SELECT source_id, axis, rate AS frequency, std / rms AS r, 100 * abs(rate - 0.12::DOUBLE) / 0.12::DOUBLE AS error FROM inventory WHERE rate IS NOT NULL)
        SELECT source_id, axis, round(frequency, 6) AS frequency, round(r, 6) AS r, round(error, 6) AS error, round(0.7::DOUBLE * abs(r) + 0.3::DOUBLE * exp(-error / 25), 6) AS score FROM e"""),
    "archive_metrics_long": (archive_metrics_long, f"{A} SELECT source_id, axis, unnest(['rms', 'std', 'duration']) AS metric, round(unnest([rms, std, duration]), 6) AS value FROM inventory"),
    "archive_metrics_pivot": (archive_metrics_pivot, f"{A} SELECT source_id, {', '.join(f'''round(max(CASE WHEN axis = '{x}' THEN rms END), 6) AS {x}''' for x in AXES)} FROM inventory GROUP BY 1"),
    "runs_canonical": (runs_canonical, f"{R}, {CANON.format(share=0.99)} SELECT *, rank = 1 AS chosen FROM canon"),
    "runs_coverage": (runs_coverage, f"{R}, c AS (SELECT *, {PCT} FROM runs) SELECT * REPLACE (round(coverage, 6) AS coverage, round(conditional, 6) AS conditional, round(effective, 6) AS effective) FROM c"),
    "runs_methods": (runs_methods, f"""{R}, {CANON.format(share=0.5)}, c AS (SELECT *, {PCT} FROM canon WHERE rank = 1) SELECT method, count(*) AS runs, count(*) FILTER (full_length) AS "full", round(100.0::DOUBLE * sum(successful) FILTER (full_length) / sum(expected) FILTER (full_length), 6) AS weighted,
        round(avg(effective), 6) AS mean, round(quantile_cont(effective, 0.5), 6) AS median, round(min(effective), 6) AS low, round(max(effective), 6) AS high, count(*) FILTER (NOT full_length) AS partial FROM c GROUP BY 1"""),
    "runs_status": (runs_status, f"""{R} SELECT method, CASE WHEN s_suppkey IS NULL THEN 'missing_metadata' WHEN observed < 10 THEN 'too_short' ELSE 'ok' END AS status, count(*) AS n, sum(points)::BIGINT AS points
        FROM runs LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = video_id GROUP BY 1, 2"""),
    "runs_union": (runs_union, f"{R} SELECT method, count(*) AS n, count(CASE WHEN path = 'F' THEN 1 END) AS with_observed, count(CASE WHEN path = 'O' THEN 1 END) AS with_points FROM runs WHERE path IN ('F', 'O') GROUP BY 1"),
    "videos_compared": (videos_compared, f"{D} SELECT frame % 50 AS video, count(*) AS n_rows, count(DISTINCT frame) AS frames, count(DISTINCT class_id) AS tracks, round(avg(score), 6) AS score, round(avg(area), 6) AS area FROM detections GROUP BY 1"),
    "videos_top": (videos_top, f"{D} SELECT frame % 50 AS video, count(*) AS n_rows, count(DISTINCT frame) AS frames, count(DISTINCT class_id) AS tracks, round(avg(score), 6) AS score, round(avg(area), 6) AS area FROM detections GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "frame_gaps": (frame_gaps, f"{D} SELECT class_id, gap, count(*) AS n FROM (SELECT class_id, frame - lag(frame) OVER (PARTITION BY class_id ORDER BY frame) AS gap FROM (SELECT DISTINCT class_id, frame FROM detections WHERE score > 0.7)) WHERE gap IS NOT NULL GROUP BY 1, 2"),
    "frame_trails": (frame_trails, f"""{D} SELECT class_id, frame, (sum(n) OVER w)::BIGINT AS trail, round(avg(s) OVER w, 6) AS mean_score FROM (SELECT class_id, frame, count(*) AS n, avg(score) AS s FROM detections WHERE score > 0.5 GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY class_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
    "nearest_track": (nearest_track, f"""{D}, seg AS (SELECT frame, avg(x) AS sx, avg(y) AS sy FROM detections WHERE class_id = '1-URGENT' GROUP BY 1), d AS (SELECT frame, object_id, round((x - sx)^2 + (y - sy)^2, 6) AS d2 FROM detections JOIN seg USING (frame) WHERE class_id <> '1-URGENT')
        SELECT frame, arg_min(object_id, (d2, object_id)) AS object_id, round(min(d2), 4) AS d2 FROM d GROUP BY 1"""),
    "first_tracks": (first_tracks, f"{D} SELECT class_id, min(frame) AS first_frame, min(object_id) AS first_object FROM detections GROUP BY 1 ORDER BY 2, 1 LIMIT 3"),
    "chunks": (chunks, f"{D} SELECT frame // 100 AS chunk, count(*) AS n, min(frame) AS low, max(frame) AS high, round(avg(score), 6) AS score FROM detections GROUP BY 1"),
    "mask_brightness": (mask_brightness, f"{P} SELECT frame, round(avg(v), 6) AS mean_v, quantile_cont(v, 0.5) AS med_v, count(*) AS n FROM pixels GROUP BY 1"),
    "mask_gain": (mask_gain, f"""{P}, g AS (SELECT frame, CASE WHEN avg(v) > 0 THEN 120 / avg(v) ELSE 1 END AS gain FROM pixels GROUP BY 1) SELECT frame, round(avg(least(255, greatest(0, v * gain))), 6) AS mean_out, round(max(least(255, greatest(0, v * gain))), 6) AS max_out,
        round(any_value(gain), 6) AS gain FROM pixels JOIN g USING (frame) GROUP BY 1"""),
    "mask_histogram": (mask_histogram, f"{P} SELECT frame, v, count(*) AS n, (sum(count(*)) OVER (PARTITION BY frame ORDER BY v))::BIGINT AS up_to FROM pixels GROUP BY 1, 2"),
    "mask_otsu": (mask_otsu, f"""{P}, h AS (SELECT frame, v, count(*) AS n FROM pixels GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY frame) AS nt, sum(n * v) OVER (PARTITION BY frame) AS st FROM h WINDOW w AS (PARTITION BY frame ORDER BY v)),
        b AS (SELECT frame, v, n0 * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0))^2 AS between_ FROM c WHERE n0 < nt) SELECT frame, arg_max(v, (round(between_, 6), -v)) AS threshold, round(max(between_), 3) AS "between" FROM b GROUP BY 1"""),
    "mask_equalised": (mask_equalised, f"""{P}, h AS (SELECT frame, v, sum(count(*)) OVER (PARTITION BY frame ORDER BY v) AS c FROM pixels GROUP BY 1, 2), e AS (SELECT *, min(c) OVER (PARTITION BY frame) AS a, max(c) OVER (PARTITION BY frame) AS z FROM h)
        SELECT frame, px, CASE WHEN z > a THEN round(255.0::DOUBLE * (c - a)::DOUBLE / (z - a)::DOUBLE)::BIGINT ELSE v END AS equalised FROM pixels JOIN e USING (frame, v)"""),
    "mask_overlap": (mask_overlap, f"{P}, {COUNTS} SELECT frame, tp, fp, fn, tn, round(iou, 6) AS iou, round(dice, 6) AS dice, round(area_ratio, 6) AS area_ratio FROM counts"),
    "mask_class_summary": (mask_class_summary, f"""{P}, {COUNTS} SELECT label AS class_id, count(*) AS n, round(avg(iou), 6) AS mean, round(quantile_cont(iou, 0.5), 6) AS median, round(stddev_pop(iou), 6) AS std, round(min(iou), 6) AS low, round(max(dice), 6) AS best_dice
        FROM counts JOIN embeddings ON vec_id = frame GROUP BY 1"""),
    "mask_sets": (mask_sets, f"{P}, {COUNTS} SELECT frame, tp + fp + fn AS joined, tp AS shared, fn AS lost FROM counts"),
    "mask_edges": (mask_edges, f"""{P}, s AS (SELECT frame, y, abs(lead(v) OVER w - lag(v) OVER w) / 2 AS d FROM pixels WINDOW w AS (PARTITION BY frame, x ORDER BY y)), p AS (SELECT frame, y, avg(d) * exp(-0.5::DOUBLE * ((y - 3.5::DOUBLE) / 2)^2) AS s FROM s WHERE d IS NOT NULL GROUP BY 1, 2),
        m AS (SELECT frame, y, avg(s) OVER (PARTITION BY frame ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM p) SELECT frame, arg_max(y, (round(s, 6), -y)) AS edge, round(max(s), 4) AS signal FROM m GROUP BY 1"""),
    "annotations_shapes": (annotations_shapes, """WITH l AS (SELECT event_type, (props->>'k')::INT AS k, CASE WHEN event_type LIKE '%w' THEN 'edge' WHEN (props->>'k')::INT > 50 THEN 'large' ELSE 'ignored' END AS label FROM events)
        SELECT event_type, count(CASE WHEN label = 'edge' THEN 1 END) AS edge, count(CASE WHEN label = 'large' THEN 1 END) AS large, count(CASE WHEN label = 'ignored' THEN 1 END) AS ignored, round(avg(k), 6) AS mean_k FROM l GROUP BY 1"""),
}
