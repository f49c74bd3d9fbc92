"""Queries that summarise runs, points and masks, and bring a frame's objects, trail and files together, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.operators import masks, series, spectral, summaries
from signalframe.plans.adapters import DETECTIONS, PIXELS, POINTS, SIGNALS, detections, pixels, points, signals, table
from signalframe.plans.archive_queries import COUNTS, P, shifted_masks
from signalframe.plans.point_queries import rounded
from signalframe.plans.recording_queries import SPECTRA
from signalframe.plans.series_queries import GRID, STEP, grid

def run_of():
    return (F.col("frame") % 20).alias("run")


def frame_times(spark, sf):
    """Frames of twenty runs with a computing time each, and whether they have a detection of 0.6 or more."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"), ((F.col("c_acctbal") + 1000) / 1e6).alias("compute_time"))
    found = detections(spark, sf).where("score >= 0.6").select("frame").distinct().withColumn("_d", F.lit(1))
    return rows.join(found, "frame", "left").select(run_of(), "frame", "compute_time", F.coalesce("_d", F.lit(0)).alias("has_detection"))


TIMES = "times AS (SELECT c_custkey % 20 AS run, c_custkey AS frame, (c_acctbal + 1000) / 1e6::DOUBLE AS compute_time, (c_custkey IN (SELECT frame FROM detections WHERE score >= 0.6))::INT AS has_detection FROM customer)"


def detector_runs(spark, sf):
    objects = detections(spark, sf).where("score >= 0.6").select(run_of(), "score", "area")
    return rounded(summaries.detector_run(frame_times(spark, sf), objects, ["run"]), 6)


def run_benchmarks(spark, sf):
    frames = frame_times(spark, sf)
    source = frames.groupBy("run").agg(F.count("*").alias("source_frames"), F.sum("compute_time").alias("runtime"))
    runs = source.withColumns({"start_frame": F.when(F.col("run") % 3 == 0, 10).otherwise(0).cast("long"), "end_frame": F.col("source_frames")})
    return rounded(summaries.benchmark_row(runs, frames.where("run % 4 <> 1 or frame > 100"), ["run"]), 6)


def run_time_base(spark, sf):
    return rounded(summaries.time_base(signals(spark, sf).select("source_id", "t").distinct(), ["source_id"], 48.0), 6)


def point_motion_verdicts(spark, sf):
    rows = points(spark, sf)
    valid = rows.where("status = 1").select("point_id", F.floor(F.col("frame") / 200).cast("long").alias("k"), "y")
    mean = valid.groupBy("point_id", "k").agg(F.avg("y").alias("value"))
    spectrum = spectral.spectrum(spectral.prepared(mean, ["point_id"]), 1.0, 0.0, 0.5, keys=["point_id"])
    return rounded(summaries.point_motion(rows, spectral.dominant(spectrum, ["point_id"])), 5)


def frame_objects(spark, sf):
    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"))
    found = summaries.objects_by_frame(frames, detections(spark, sf), ["frame"], ["object_id", "class_id"])
    return found.select("frame", F.size("objects").alias("n"), F.array_join(F.transform("objects", lambda o: F.concat(o["object_id"].cast("string"), F.lit("/"), o["class_id"])), ";").alias("objects"))


def trail_rows(spark, sf):
    rows = detections(spark, sf).where("score > 0.5").select("class_id", "frame", "object_id", "x", "y")
    return summaries.trails(rows, ["class_id"], 5).select("class_id", "at", "frame", "object_id", "x", "y")


def manifest_flags(spark, sf):
    rows = detections(spark, sf)
    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"))
    truth = pixels(spark, sf).where("on").select("frame")
    return summaries.manifest(frames, "frame", frames=table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame")), predictions=rows.where("score > 0.9"), truth=truth)


def mask_class_distribution(spark, sf):
    rows = pixels(spark, sf)
    truth, predicted = shifted_masks(spark, sf)
    each = masks.overlap_counts(truth, predicted, 64)
    return rounded(summaries.distribution(each.join(rows.select("frame", "class_id").distinct(), "frame"), ["class_id"], ["iou", "dice"]), 6)


def mask_roi_brightness(spark, sf):
    return rounded(masks.brightness(pixels(spark, sf), (2, 1, 4, 5)), 6)


def mask_edges_gated(spark, sf):
    return rounded(masks.edge_rows(pixels(spark, sf), 3.5, 2.0, taps=7, least=5.0), 4)


def spectrum_profile(spark, sf):
    rows = grid(spark, sf)
    spectra = spectral.spectrum(spectral.prepared(rows).where("n >= 3"), STEP, 0.0, 0.0834)
    shape = spectral.features(spectra).join(spectral.dominant(spectra).select(*series.KEYS, F.col("frequency").alias("dominant")), series.KEYS)
    size = rows.groupBy(*series.KEYS).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), (F.max("value") - F.min("value")).alias("peak_to_peak"))
    return rounded(shape.join(size, series.KEYS), 4)


def agreement_labels(spark, sf):
    rows = signals(spark, sf).groupBy("source_id", "axis").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    e, c = F.col("m") % 60, F.when(F.col("n") % 7 != 0, F.col("s") % 1)
    label = summaries.physical_agreement(F.col("n") < 9, F.col("n") % 5 != 0, F.when(F.col("n") % 11 != 0, e), e / 3, c)
    return rows.select("source_id", "axis", label.alias("physical"), summaries.time_similarity(c).alias("time_domain"))


QUERIES = {
    "detector_runs": (detector_runs, f"""WITH {DETECTIONS}, {TIMES}, f AS (SELECT run, count(*) AS processed, sum(has_detection)::BIGINT AS with_detections, avg(compute_time) AS mean_time, quantile_cont(compute_time, 0.5) AS median_time, quantile_cont(compute_time, 0.95) AS p95_time FROM times GROUP BY 1),
        o AS (SELECT frame % 20 AS run, count(*) AS objects, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score, avg(area) AS mean_area FROM detections WHERE score >= 0.6 GROUP BY 1)
        SELECT run, processed, with_detections, processed - with_detections AS without_detections, round(100.0::DOUBLE * with_detections / processed, 6) AS output_rate, round(mean_time, 6) AS mean_time, round(median_time, 6) AS median_time, round(p95_time, 6) AS p95_time,
        round(1 / mean_time, 6) AS fps, coalesce(objects, 0) AS objects, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, round(mean_area, 6) AS mean_area FROM f LEFT JOIN o USING (run)"""),
    "run_benchmarks": (run_benchmarks, f"""WITH {DETECTIONS}, {TIMES}, s AS (SELECT run, count(*) AS source_frames, sum(compute_time) AS runtime, CASE WHEN run % 3 = 0 THEN 10 ELSE 0 END::BIGINT AS start_frame FROM times GROUP BY 1),
        d AS (SELECT run, count(*) AS processed, sum(has_detection)::BIGINT AS with_detections FROM times WHERE run % 4 <> 1 OR frame > 100 GROUP BY 1), j AS (SELECT s.*, source_frames AS end_frame, source_frames - start_frame AS expected, coalesce(processed, 0) AS processed, coalesce(with_detections, 0) AS with_detections FROM s LEFT JOIN d USING (run))
        SELECT run, source_frames, round(runtime, 6) AS runtime, start_frame, end_frame, expected, processed, with_detections, processed - with_detections AS without_detections, round(CASE WHEN processed > 0 AND expected > 0 THEN 100.0::DOUBLE * processed / expected ELSE 0 END, 6) AS coverage,
        round(CASE WHEN processed > 0 THEN 100.0::DOUBLE * with_detections / processed END, 6) AS output_rate, round(CASE WHEN processed > 0 THEN runtime / processed END, 6) AS frame_time, round(CASE WHEN processed > 0 THEN processed / runtime END, 6) AS fps, start_frame = 0 AND processed = source_frames AS full_length FROM j"""),
    "run_time_base": (run_time_base, f"""WITH {SIGNALS}, d AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t) AS dt FROM (SELECT DISTINCT source_id, t FROM signals)) SELECT source_id, round(quantile_cont(dt, 0.5), 6) AS median_step, round(CASE WHEN quantile_cont(dt, 0.5) > 0 THEN 1 / quantile_cont(dt, 0.5) END, 6) AS fps
        FROM d WHERE dt IS NOT NULL GROUP BY 1"""),
    "point_motion_verdicts": (point_motion_verdicts, f"""WITH {POINTS}, means AS (SELECT point_id, frame // 200 AS k, avg(y) AS value FROM points WHERE status = 1 GROUP BY 1, 2), {SPECTRA.format(keys='point_id', source='means')},
        f AS (SELECT point_id, arg_min(x, t) AS fx, arg_min(y, t) AS fy FROM points WHERE status = 1 GROUP BY 1),
        m AS (SELECT point_id, count(*) AS total_samples, count(*) FILTER (status = 1) AS num_samples, max(x - fx) FILTER (status = 1) AS x1, min(x - fx) FILTER (status = 1) AS x0, max(y - fy) FILTER (status = 1) AS y1, min(y - fy) FILTER (status = 1) AS y0, sqrt(avg((x - fx)^2) FILTER (status = 1)) AS rms_x,
          sqrt(avg((y - fy)^2) FILTER (status = 1)) AS rms_y, avg(x) FILTER (status = 1) AS mean_x, avg(y) FILTER (status = 1) AS mean_y, avg(jump_px) FILTER (status = 1) AS mean_jump, max(jump_px) FILTER (status = 1) AS max_jump FROM points LEFT JOIN f USING (point_id) GROUP BY 1)
        SELECT point_id, total_samples, num_samples, round(num_samples / total_samples, 5) AS success_rate, round((x1 - x0) / 2, 5) AS amp_x, round((y1 - y0) / 2, 5) AS amp_y, round(rms_x, 5) AS rms_x, round(rms_y, 5) AS rms_y, round(mean_x, 5) AS mean_x, round(mean_y, 5) AS mean_y, round(mean_jump, 5) AS mean_jump,
        round(max_jump, 5) AS max_jump, round(frequency, 5) AS dominant, num_samples / total_samples >= 0.8 AND mean_jump <= 3 AND frequency IS NOT NULL AS valid, CASE WHEN num_samples < 10 THEN 'too_few_valid_samples' WHEN num_samples / total_samples >= 0.8 AND mean_jump <= 3 AND frequency IS NOT NULL THEN 'ok' ELSE 'low_quality_tracking' END AS reason
        FROM m LEFT JOIN d USING (point_id)"""),
    "frame_objects": (frame_objects, f"WITH {DETECTIONS} SELECT c_custkey AS frame, count(object_id)::INT AS n, coalesce(string_agg(object_id || '/' || class_id, ';' ORDER BY object_id, class_id), '') AS objects FROM customer LEFT JOIN detections ON frame = c_custkey GROUP BY 1"),
    "trail_rows": (trail_rows, f"WITH {DETECTIONS}, r AS (SELECT * FROM detections WHERE score > 0.5) SELECT r.class_id, f.frame AS \"at\", r.frame, object_id, x, y FROM r JOIN (SELECT DISTINCT class_id, frame FROM r) f ON f.class_id = r.class_id AND r.frame > f.frame - 5 AND r.frame <= f.frame"),
    "manifest_flags": (manifest_flags, f"""WITH {DETECTIONS}, {PIXELS}, m AS (SELECT c_custkey AS frame, c_custkey IN (SELECT s_suppkey FROM supplier) AS found_frames, c_custkey IN (SELECT frame FROM detections WHERE score > 0.9) AS found_predictions, c_custkey IN (SELECT frame FROM pixels WHERE "on") AS found_truth FROM customer)
        SELECT *, concat_ws(',', CASE WHEN NOT found_frames THEN 'frames' END, CASE WHEN NOT found_predictions THEN 'predictions' END, CASE WHEN NOT found_truth THEN 'truth' END) AS missing FROM m"""),
    "mask_class_distribution": (mask_class_distribution, f"""{P}, {COUNTS} SELECT label AS class_id, count(*) AS n, {', '.join(f'round({f}({c}{more}), 6) AS {name}_{c}' for c in ('iou', 'dice') for name, f, more in (('mean', 'avg', ''), ('std', 'stddev_pop', ''), ('min', 'min', ''), ('max', 'max', ''), ('median', 'quantile_cont', ', 0.5')))}
        FROM counts JOIN embeddings ON vec_id = frame GROUP BY 1"""),
    "mask_roi_brightness": (mask_roi_brightness, f"{P} SELECT frame, round(avg(v), 6) AS mean_v, quantile_cont(v, 0.5) AS med_v, count(*) AS n FROM pixels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5 GROUP BY 1"),
    "mask_edges_gated": (mask_edges_gated, f"""{P}, s AS (SELECT frame, y, abs(lead(v) OVER w - lag(v) OVER w) / 2 AS d FROM pixels WINDOW w AS (PARTITION BY frame, x ORDER BY y)), p AS (SELECT frame, y, avg(d) * exp(-0.5::DOUBLE * ((y - 3.5::DOUBLE) / 2)^2) AS s FROM s WHERE d IS NOT NULL GROUP BY 1, 2),
        m AS (SELECT frame, y, avg(s) OVER (PARTITION BY frame ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM p) SELECT frame, CASE WHEN max(s) >= 5 THEN arg_max(y, (round(s, 6), -y)) END AS edge, round(max(s), 4) AS signal, max(s) >= 5 AS success FROM m GROUP BY 1"""),
    "spectrum_profile": (spectrum_profile, f"""WITH {SIGNALS}, {GRID}, {SPECTRA.format(keys='source_id, axis', source='grid')}, r AS (SELECT source_id, axis, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS peak_to_peak FROM grid GROUP BY 1, 2),
        p AS (SELECT source_id, axis, sum(amplitude^2) AS p, sum(amplitude^2 * bin / (n * {STEP}::DOUBLE)) AS pf, sum(amplitude^2 * (bin / (n * {STEP}::DOUBLE))^2) AS pff, max(amplitude^2) AS top, quantile_cont(amplitude^2, 0.5) AS mid FROM a WHERE bin > 0 GROUP BY 1, 2)
        SELECT source_id, axis, round(pf / p, 4) AS centroid, round(sqrt(greatest(0, pff / p - (pf / p)^2)), 4) AS bandwidth, round(top / mid, 4) AS prominence, round(round(frequency * n) / (n * {STEP}::DOUBLE), 4) AS dominant, round(rms, 4) AS rms, round(peak_to_peak, 4) AS peak_to_peak FROM p JOIN d USING (source_id, axis) JOIN r USING (source_id, axis)"""),
    "agreement_labels": (agreement_labels, f"""WITH {SIGNALS}, g AS (SELECT source_id, axis, count(*) AS n, avg(value) % 60 AS e, CASE WHEN count(*) % 7 <> 0 THEN stddev_pop(value) % 1 END AS c FROM signals GROUP BY 1, 2)
        SELECT source_id, axis, CASE WHEN n < 9 THEN 'analysis_failed' WHEN n % 5 = 0 THEN 'decay_not_confirmed' WHEN n % 11 = 0 THEN 'insufficient_metrics' WHEN e <= 10 AND e / 3 <= 5 AND coalesce(c, -1) >= 0.8 THEN 'strong_physical_agreement'
          WHEN e <= 25 AND e / 3 <= 10 AND coalesce(c, -1) >= 0.5 THEN 'moderate_physical_agreement' WHEN e <= 50 AND e / 3 <= 20 THEN 'weak_physical_agreement' ELSE 'no_physical_agreement' END AS physical,
          CASE WHEN c IS NULL THEN 'validation_failed' WHEN c >= 0.7 THEN 'strong_time_domain_similarity' WHEN c >= 0.4 THEN 'moderate_time_domain_similarity' WHEN c >= 0.2 THEN 'weak_time_domain_similarity' ELSE 'no_direct_time_domain_similarity' END AS time_domain FROM g"""),
}
