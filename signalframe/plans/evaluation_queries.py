"""Queries that evaluate extraction, rank candidates and compare spectra, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalframe.functions import scalars
from signalframe.operators import extraction, matching, ranking, series, spectral
from signalframe.plans.adapters import DETECTIONS, PIXELS, POINTS, RUNS, SIGNALS, detections, pixels, points, runs, signals, table
from signalframe.plans.archive_queries import INTERVALS, INVENTORY, archive, near
from signalframe.plans.point_queries import rounded
from signalframe.plans.series_queries import GRID, PAIRS, STEP, grid, pairs
from signalframe.plans.spectral_queries import COHERENCE, DOMINANT, HIGH, S, spectra


def video(rows, n=25):
    return rows.withColumn("video_id", F.col("frame") % n)


def sources(spark, sf):
    """Frames of each video: all orders, whether they have tracked points or not."""
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 25).alias("video_id")).agg(F.count("*").alias("source_frames"))


SOURCES = "sources AS (SELECT o_orderkey % 25 AS video_id, count(*) AS source_frames FROM orders GROUP BY 1)"
RATES = "round(100.0 * observed / nullif(expected, 0), 6) AS coverage, round(100.0 * successful / nullif(observed, 0), 6) AS conditional, round(100.0 * successful / nullif(expected, 0), 6) AS effective, greatest(expected - observed, 0) AS missing, observed - successful AS failed, expected > 0 AND observed >= ceil(expected * 0.99::DOUBLE) AS full_length"


def frames_sql(rows, success, expected):
    return f"""found AS (SELECT video_id, count(DISTINCT frame) AS observed, count(DISTINCT CASE WHEN {success} THEN frame END) AS successful FROM {rows} WHERE frame IS NOT NULL GROUP BY 1),
      j AS (SELECT video_id, source_frames, coalesce(observed, 0) AS observed, coalesce(successful, 0) AS successful, {expected} AS expected FROM sources LEFT JOIN found USING (video_id)) SELECT *, {RATES} FROM j"""


def success_points(spark, sf):
    return rounded(extraction.tracked_point_success(video(points(spark, sf)), sources(spark, sf), 3), 6)


def success_flow(spark, sf):
    rows = video(points(spark, sf)).selectExpr("video_id", "frame", "nullif(dx, 0) as mean_dx", "nullif(dy, 0) as mean_dy")
    return rounded(extraction.frame_success(rows, sources(spark, sf), extraction.any_finite("mean_dx", "mean_dy"), True), 6)


def success_detector(spark, sf):
    word = F.expr("case o_orderstatus when 'F' then 'Detected' when 'O' then ' lost ' else '1' end")
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 25).alias("video_id"), F.col("o_orderkey").alias("frame"), word.alias("detected"), F.col("o_totalprice").alias("score"))
    rows = rows.withColumn("detected", F.when(F.col("video_id") < 12, F.regexp_replace("detected", "1", "ok")).otherwise(F.col("detected")))  # some videos with words only
    return rounded(extraction.reported_success(rows, sources(spark, sf), extraction.DETECTOR_SUCCESS, "score"), 6)


def success_classical(spark, sf):
    rows = pixels(spark, sf).groupBy("frame").agg(F.count_if("on").alias("area")).withColumn("video_id", F.col("frame") % 25)
    rows = rows.withColumn("inner_pipe_valid", F.col("area") >= 32)
    return rounded(extraction.reported_success(rows, sources(spark, sf), extraction.CLASSICAL_SUCCESS), 6)


def label_classes(spark, sf):
    label = F.concat("lang", F.expr("case doc_id % 3 when 0 then '_inner_pipe' when 1 then '_particle_bed' else '_other' end"))
    return table(spark, sf, "documents").groupBy(extraction.label_class(label).alias("class")).agg(F.count("*").alias("n"))


def roi_below_edge(spark, sf):
    rows = detections(spark, sf)
    edges = rows.where("score > 0.5").groupBy("frame").agg(F.avg("y").alias("edge"))
    return extraction.roi_at_edge(rows.select("frame", "object_id", "x", "y", "w", "h"), edges, 12, 40, 1900, 1060).drop("edge")


def frames_with_diagnostics(spark, sf):
    rows = points(spark, sf)
    diagnostics = rows.where("status = 0").groupBy("frame", "t").agg(F.count("*").alias("lost"), F.max("fb_error").alias("worst"))
    return rounded(extraction.with_diagnostics(rows.groupBy("frame", "t").agg(F.count("*").alias("n")), diagnostics, ["frame", "t"]), 6)


def frame_plot_series(spark, sf):
    return rounded(detections(spark, sf).groupBy("frame").agg(F.count("*").alias("tracks"), F.avg("y").alias("edge"), F.avg(F.col("x") + F.col("w") / 2).alias("centre")), 6)


def experiments_compared(spark, sf):
    rows = detections(spark, sf).groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("frames"), *[F.avg(c).alias(f"mean_{c}") for c in ("score", "area", "w", "h")])
    return rounded(rows, 6)


def frame_manifest_all(spark, sf):
    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"))
    found = detections(spark, sf).groupBy("frame").agg(F.count("*").alias("objects"), F.count_if(F.col("score") > 0.5).alias("good"))
    rows = frames.join(found, "frame", "left")
    return rows.select("frame", F.col("objects").isNotNull().alias("has_objects"), (F.coalesce("good", F.lit(0)) > 0).alias("has_good"), F.coalesce("objects", F.lit(0)).alias("objects"))


def axes_missing_all(spark, sf):
    have = signals(spark, sf).select("source_id", "axis").distinct()
    wanted = have.select("source_id").distinct().withColumn("axis", F.explode(F.array(*[F.lit(x) for x in ("click", "view", "tilt")])))
    return wanted.join(have, ["source_id", "axis"], "left_anti")


def runs_still_open(spark, sf):
    done = runs(spark, sf).where("successful * 100 >= observed * 55").select("method", "video_id").distinct()
    return runs(spark, sf).select("method", "video_id").distinct().join(done, ["method", "video_id"], "left_anti")


def recordings(spark, sf):
    """Features of each recording: frequency, centroid, bandwidth, duration, quality."""
    at = F.max_by("frequency", F.struct(F.round("amplitude", 9), -F.col("bin"))).alias("frequency")  # as spectral.dominant
    found = spectral.features(spectra(spark, sf), ["source_id", "axis"], at, (F.first("n") * STEP).alias("duration"))
    return found.withColumn("quality", ranking.quality_score(F.col("duration"), F.lit(1 / STEP), HIGH, F.col("prominence")))


FEATURES = f"""{S}, {DOMINANT}, p AS (SELECT source_id, axis, sum(amplitude^2) AS p, sum(amplitude^2 * frequency) AS pf, sum(amplitude^2 * frequency^2) AS pff, max(amplitude^2) AS top, quantile_cont(amplitude^2, 0.5) AS mid FROM spectra WHERE bin > 0 GROUP BY 1, 2),
  l AS (SELECT source_id, axis, count(*) * {STEP}::DOUBLE AS duration FROM grid GROUP BY 1, 2),
  rec AS (SELECT source_id, axis, d.frequency, CASE WHEN p > 0 THEN pf / p END AS centroid, CASE WHEN p > 0 THEN sqrt(greatest(0, pff / p - (pf / p)^2)) END AS bandwidth, CASE WHEN mid > 0 THEN top / mid END AS prominence, duration FROM dominant d JOIN p USING (source_id, axis) JOIN l USING (source_id, axis)),
  recordings AS (SELECT *, greatest(0.0, least(100.0, 100 * (0.35::DOUBLE * least(1, duration / 20) + 0.25::DOUBLE * least(1, (1 / {STEP}::DOUBLE) / greatest(2.5::DOUBLE * {HIGH}::DOUBLE, 1)) + 0.4::DOUBLE * least(1, log10(greatest(coalesce(prominence, 1), 1)) / 3)))) AS quality FROM rec)"""


def recording_quality(spark, sf):
    return rounded(recordings(spark, sf).select("source_id", "axis", "duration", "quality"), 3)


def recordings_ranked(spark, sf):
    """Recordings of sources divisible by 50 against all recordings."""
    columns = ("frequency", "centroid", "bandwidth", "duration", "quality")
    rows = recordings(spark, sf).withColumn("id", F.concat_ws("/", "source_id", "axis"))
    left = rows.where("source_id % 50 = 0").select(F.col("id").alias("left_id"), *[F.col(c).alias(f"left_{c}") for c in columns])
    right = rows.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"right_{c}") for c in columns])
    return rounded(ranking.ranked_partners(left, right, 3).select("left_id", "rank", "score"), 3)


def sim(c, weight, decay, floor):
    return f"{weight}::DOUBLE * exp(-{decay}::DOUBLE * abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), {floor}::DOUBLE))"


def candidates(spark, sf):
    rows = archive(spark, sf).select("source_id", "axis", scalars.relative_error(F.col("rate"), F.lit(0.12)).alias("frequency_error"), scalars.relative_error(F.col("rms"), F.lit(30.0)).alias("peak_error"))
    near_rows = near(spark, sf).select("source_id", "axis", "window_id", F.round("overlap", 6).alias("overlap"), F.round("gap", 6).alias("gap"))
    return rounded(near_rows.join(rows, ["source_id", "axis"]).withColumn("peak_rank", (F.col("window_id") % 3 + 1)), 6)


CANDIDATES = f"""{SIGNALS}, {INVENTORY}, {INTERVALS}, cand AS (SELECT n.source_id, n.axis, window_id, round(n.overlap, 6) AS overlap, round(n.gap, 6) AS gap, round(100 * abs(rate - 0.12::DOUBLE) / 0.12::DOUBLE, 6) AS frequency_error,
  round(100 * abs(rms - 30) / 30, 6) AS peak_error, window_id % 3 + 1 AS peak_rank FROM near n JOIN inventory i ON n.source_id = i.source_id AND n.axis = i.axis)"""


def candidate_lists(spark, sf):
    rows = ranking.candidate_lists(candidates(spark, sf), 2.0, 60.0, 20, ["source_id", "axis", "window_id"])
    return rows.select("list", "rank", "source_id", "axis", "window_id")


def candidate_scores(spark, sf):
    rows = ranking.combined_scores(candidates(spark, sf), 30.0, 60.0, 0.5, 1.5)
    return rounded(rows.select("source_id", "axis", "window_id", "time_score", "frequency_score", "combined"), 5)


def results(spark, sf):
    """One comparison of each source: candidate, group, status, pearson, rmse, final_rank."""
    rows = pairs(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"), F.when((F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), F.corr("a", "b")).alias("pearson"), F.sqrt(F.avg((F.col("b") - F.col("a")) ** 2)).alias("rmse"))
    status = F.when(F.col("n") >= 20, "Success").otherwise("failed")
    return rounded(rows.select(F.col("source_id").alias("candidate"), (F.col("source_id") % 7).alias("group"), status.alias("status"), "pearson", "rmse", (F.col("source_id") % 11).alias("final_rank")), 6)


RESULTS = f"""WITH {SIGNALS}, {GRID}, {PAIRS}, results AS (SELECT source_id AS candidate, source_id % 7 AS "group", CASE WHEN count(*) >= 20 THEN 'Success' ELSE 'failed' END AS status,
  round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS pearson, round(sqrt(avg((b - a)^2)), 6) AS rmse, source_id % 11 AS final_rank FROM pairs GROUP BY source_id)"""


def best_by_mode(spark, sf):
    rows, out = results(spark, sf), None
    for mode in ranking.MODES:
        best = ranking.best_candidate(rows, mode, ["group"], "candidate").select(F.lit(mode).alias("mode"), "group", "candidate")
        out = best if out is None else out.union(best)
    return out


def results_ranked(spark, sf):
    return ranking.ranked_results(results(spark, sf), ["group"], [("rmse", False), ("abs(pearson)", True)], ["candidate"]).select("group", "rank", "candidate", "status")


def axes_compared(spark, sf):
    rows = archive(spark, sf).select("source_id", "axis", F.when(F.col("rows") >= 10, "success").otherwise("failed").alias("status"), F.round("rate", 6).alias("score"), F.round("std", 6).alias("correlation"))
    return ranking.ranked_results(rows, ["source_id"], [("score", True), ("abs(correlation)", True)], ["axis"]).select("source_id", "rank", "axis", "status")


def candidates_of_video(spark, sf):
    rows = results(spark, sf).select(F.concat(F.lit(" Video"), F.col("group")).alias("video_id"), F.col("final_rank").alias("rank_for_video"), F.col("pearson").alias("score"), F.col("candidate").alias("source_row"))
    return ranking.candidates_of(rows, "VIDEO3", 5).select("source_row", "rank_for_video", "score")


def axis_products(spark, sf):
    rows = series.axis_pairs(grid(spark, sf))
    return rounded(series.pair_metrics(rows, ["source_id", "left", "right"]).select("source_id", "left", "right", "n", "rmse", "mae"), 5)


def pair_shifted(spark, sf):
    rows = signals(spark, sf).withColumn("t", F.when(F.col("axis") == "view", F.col("t") - 7.5).otherwise(F.col("t")))
    both = series.paired(series.resampled(rows, STEP), "click", "view")
    return rounded(series.pair_metrics(both, ["source_id"]).select("source_id", "n", "rmse", "bias"), 5)


def coherence_evaluated(spark, sf):
    return rounded(spectral.coherence_summary(spectral.coherence(pairs(spark, sf), 16, STEP, ["source_id"]), 0.03, 0.012, 0.01, 0.06, ["source_id"]), 4)


def psd_peaks(spark, sf):
    rows = spectral.coherence(pairs(spark, sf), 16, STEP, ["source_id"]).select("source_id", "bin", "frequency", F.col("psd_a").alias("amplitude"))
    return rounded(spectral.peaks(rows, 10, ["source_id"]).select("source_id", "rank", "frequency"), 5)


def harmonics_compared(spark, sf):
    rows = spectral.harmonics(spectra(spark, sf), 0.0071, 5, 0.002, HIGH)
    return rounded(spectral.against_reference(rows, "click", 30.0), 5)


def harmonics_preserved(spark, sf):
    return rounded(spectral.preserved(spectral.against_reference(spectral.harmonics(spectra(spark, sf), 0.0071, 5, 0.002, HIGH), "click", 30.0), ["axis"]), 5)


def envelope_normalised(spark, sf):
    rows = grid(spark, sf).withColumn("value", F.abs("value"))
    return rounded(series.normalised_envelope(rows).select("source_id", "axis", "k", "value"), 5)


HARMONICS = f"""{S}, h AS (SELECT *, round(frequency / 0.0071::DOUBLE)::INT AS harmonic FROM spectra), hs AS (SELECT source_id, axis, harmonic, arg_max(frequency, (round(amplitude, 9), -bin)) AS frequency, arg_max(amplitude, (round(amplitude, 9), -bin)) AS amplitude
  FROM h WHERE harmonic BETWEEN 1 AND 5 AND abs(frequency - harmonic * 0.0071::DOUBLE) <= 0.002::DOUBLE AND harmonic * 0.0071::DOUBLE <= {HIGH}::DOUBLE GROUP BY 1, 2, 3),
  axes AS (SELECT DISTINCT source_id, axis FROM hs WHERE axis <> 'click'),
  cmp AS (SELECT x.source_id, x.axis, r.harmonic, r.amplitude AS reference, o.amplitude, 100 * abs(o.amplitude - r.amplitude) / r.amplitude AS error, o.amplitude IS NOT NULL AS observable, coalesce(100 * abs(o.amplitude - r.amplitude) / r.amplitude <= 30, false) AS preserved
    FROM axes x JOIN hs r ON r.source_id = x.source_id AND r.axis = 'click' LEFT JOIN hs o ON o.source_id = x.source_id AND o.axis = x.axis AND o.harmonic = r.harmonic)"""
NEAR_OR_OVER = "(overlap > 0 OR gap <= 2)"
MODE_SQL = " UNION ALL ".join(
    f"""SELECT '{mode}' AS mode, "group", arg_min(candidate, ({'-' if more else ''}round({metric}, 9), candidate)) AS candidate FROM results WHERE lower(status) = 'success' AND {metric} IS NOT NULL GROUP BY 2"""
    for mode, (metric, more) in ranking.MODES.items()
)

QUERIES = {
    "success_points": (success_points, f"""WITH {POINTS}, {SOURCES}, p AS (SELECT frame % 25 AS video_id, * FROM points), f AS (SELECT video_id, frame, count(*) AS points, sum(status) AS valid FROM p GROUP BY 1, 2),
        v AS (SELECT video_id, count(*) AS observed, count(*) FILTER (valid >= 3) AS successful, sum(points)::BIGINT AS points, quantile_cont(valid, 0.5) AS median_valid, min(valid)::BIGINT AS min_valid, max(valid)::BIGINT AS max_valid FROM f GROUP BY 1),
        g AS (SELECT video_id, count(*) AS valid_points, quantile_cont(fb_error, 0.5) AS median_fb_error, quantile_cont(fb_error, 0.95) AS p95_fb_error, quantile_cont(jump_px, 0.5) AS median_jump_px, quantile_cont(jump_px, 0.95) AS p95_jump_px FROM p WHERE status = 1 GROUP BY 1),
        j AS (SELECT video_id, source_frames, points, round(median_valid, 6) AS median_valid, min_valid, max_valid, valid_points, round(median_fb_error, 6) AS median_fb_error, round(p95_fb_error, 6) AS p95_fb_error, round(median_jump_px, 6) AS median_jump_px, round(p95_jump_px, 6) AS p95_jump_px,
          round(100.0 * coalesce(valid_points, 0) / points, 6) AS point_success, coalesce(observed, 0) AS observed, coalesce(successful, 0) AS successful, greatest(source_frames - 1, 0) AS expected FROM sources LEFT JOIN v USING (video_id) LEFT JOIN g USING (video_id)) SELECT *, {RATES} FROM j"""),
    "success_flow": (success_flow, f"WITH {POINTS}, {SOURCES}, p AS (SELECT frame % 25 AS video_id, * FROM points), {frames_sql('p', 'dx <> 0 OR dy <> 0', 'greatest(source_frames - 1, 0)')}"),
    "success_detector": (success_detector, f"""WITH {SOURCES}, p AS (SELECT *, CASE WHEN video_id < 12 THEN s <> 'O' WHEN bool_or(s = 'P') OVER (PARTITION BY video_id) THEN s = 'P' ELSE s = 'F' END AS good FROM (SELECT o_orderkey % 25 AS video_id, o_orderkey AS frame, o_orderstatus AS s FROM orders)),
        {frames_sql('p', 'good', 'source_frames').replace('SELECT *, round', "SELECT *, 'detected' AS success_column, 'column' AS rule, round")}"""),
    "success_classical": (success_classical, f"""WITH {PIXELS}, {SOURCES}, p AS (SELECT frame % 25 AS video_id, frame, count(*) FILTER ("on") AS area FROM pixels GROUP BY frame),
        {frames_sql('p', 'area >= 32', 'source_frames').replace('SELECT *, round', "SELECT *, 'inner_pipe_valid' AS success_column, 'column' AS rule, round")}"""),
    "label_classes": (label_classes, "SELECT CASE doc_id % 3 WHEN 0 THEN 'inner_pipe' WHEN 1 THEN 'particle_bed' END AS class, count(*) AS n FROM documents GROUP BY 1"),
    "roi_below_edge": (roi_below_edge, f"""WITH {DETECTIONS}, e AS (SELECT frame, avg(y) AS edge FROM detections WHERE score > 0.5 GROUP BY 1), j AS (SELECT d.*, edge, greatest(0, least(trunc(edge + 12)::BIGINT, 1059)) AS ny FROM detections d LEFT JOIN e USING (frame))
        SELECT frame, object_id, CASE WHEN edge IS NULL THEN x ELSE greatest(0, least(x, 1899)) END AS x, CASE WHEN edge IS NULL THEN y ELSE ny END AS y, CASE WHEN edge IS NULL THEN w ELSE greatest(1, least(w, 1900 - x)) END AS w, CASE WHEN edge IS NULL THEN h ELSE greatest(1, least(40, 1060 - ny)) END AS h FROM j"""),
    "frames_with_diagnostics": (frames_with_diagnostics, f"WITH {POINTS} SELECT frame, round(t, 6) AS t, count(*) AS n, nullif(count(*) FILTER (status = 0), 0) AS lost, round(max(fb_error) FILTER (status = 0), 6) AS worst FROM points GROUP BY frame, t"),
    "frame_plot_series": (frame_plot_series, f"WITH {DETECTIONS} SELECT frame, count(*) AS tracks, round(avg(y), 6) AS edge, round(avg(x + w / 2), 6) AS centre FROM detections GROUP BY 1"),
    "experiments_compared": (experiments_compared, f"WITH {DETECTIONS} SELECT class_id, count(*) AS n, count(DISTINCT frame) AS frames, round(avg(score), 6) AS mean_score, round(avg(area), 6) AS mean_area, round(avg(w), 6) AS mean_w, round(avg(h), 6) AS mean_h FROM detections GROUP BY 1"),
    "frame_manifest_all": (frame_manifest_all, f"WITH {DETECTIONS} SELECT c_custkey AS frame, count(object_id) > 0 AS has_objects, count(*) FILTER (score > 0.5) > 0 AS has_good, count(object_id) AS objects FROM customer LEFT JOIN detections ON frame = c_custkey GROUP BY 1"),
    "axes_missing_all": (axes_missing_all, f"WITH {SIGNALS}, h AS (SELECT DISTINCT source_id, axis FROM signals) SELECT source_id, axis FROM (SELECT DISTINCT source_id FROM h), (VALUES ('click'), ('view'), ('tilt')) v(axis) EXCEPT SELECT * FROM h"),
    "runs_still_open": (runs_still_open, f"WITH {RUNS} SELECT DISTINCT method, video_id FROM runs EXCEPT SELECT method, video_id FROM runs WHERE successful * 100 >= observed * 55"),
    "recording_quality": (recording_quality, f"{FEATURES} SELECT source_id, axis, round(duration, 3) AS duration, round(quality, 3) AS quality FROM recordings"),
    "recordings_ranked": (recordings_ranked, f"""{FEATURES}, r AS (SELECT concat_ws('/', source_id, axis) AS id, * FROM recordings), scored AS (SELECT a.id AS left_id, b.id AS right_id, 100 * ({" + ".join(sim(c, *x) for c, x in ranking.SIMILARITY.items())} + 0.1::DOUBLE * least(a.quality, b.quality) / 100) AS score
        FROM r a JOIN r b ON a.id <> b.id WHERE a.source_id % 50 = 0) SELECT left_id, rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC NULLS LAST, right_id) AS rank FROM scored) WHERE rank <= 3"""),
    "candidate_lists": (candidate_lists, f"""WITH {CANDIDATES}, t AS (SELECT 'temporal' AS list, *, row_number() OVER (ORDER BY overlap DESC, gap, peak_error, source_id, axis, window_id) AS rank FROM cand WHERE {NEAR_OR_OVER}),
        d AS (SELECT 'dominant_frequency' AS list, *, row_number() OVER (ORDER BY frequency_error, gap, source_id, axis, window_id) AS rank FROM cand WHERE frequency_error <= 60),
        a AS (SELECT 'any_peak' AS list, *, row_number() OVER (ORDER BY peak_error, peak_rank, gap, source_id, axis, window_id) AS rank FROM cand WHERE peak_error <= 60)
        SELECT list, rank, source_id, axis, window_id FROM (SELECT * FROM t UNION ALL SELECT * FROM d UNION ALL SELECT * FROM a) WHERE rank <= 20
        UNION ALL SELECT 'simultaneous', NULL, source_id, axis, window_id FROM cand WHERE {NEAR_OR_OVER} AND peak_error <= 60"""),
    "candidate_scores": (candidate_scores, f"""WITH {CANDIDATES}, s AS (SELECT *, CASE WHEN overlap > 0 THEN 0 ELSE gap / 30 END AS ts, peak_error / 60 AS fs FROM cand)
        SELECT source_id, axis, window_id, round(ts, 5) AS time_score, round(fs, 5) AS frequency_score, round(0.25::DOUBLE * ts + 0.75::DOUBLE * fs, 5) AS combined FROM s"""),
    "best_by_mode": (best_by_mode, f"{RESULTS} {MODE_SQL}"),
    "results_ranked": (results_ranked, f"""{RESULTS} SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY lower(status) = 'success' DESC, rmse NULLS LAST, abs(pearson) DESC NULLS LAST, candidate) AS rank, candidate, status FROM results"""),
    "axes_compared": (axes_compared, f"""WITH {SIGNALS}, {INVENTORY} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY rows >= 10 DESC, round(rate, 6) DESC NULLS LAST, abs(round(std, 6)) DESC NULLS LAST, axis) AS rank, axis, CASE WHEN rows >= 10 THEN 'success' ELSE 'failed' END AS status FROM inventory"""),
    "candidates_of_video": (candidates_of_video, f"""{RESULTS} SELECT candidate AS source_row, final_rank AS rank_for_video, pearson AS score FROM results WHERE "group" = 3 ORDER BY final_rank, pearson DESC NULLS LAST, candidate LIMIT 5"""),
    "axis_products": (axis_products, f"""WITH {SIGNALS}, {GRID} SELECT l.source_id, l.axis AS "left", r.axis AS "right", count(*) AS n, round(sqrt(avg((r.value - l.value)^2)), 5) AS rmse, round(avg(abs(r.value - l.value)), 5) AS mae
        FROM grid l JOIN grid r ON l.source_id = r.source_id AND l.k = r.k AND l.axis < r.axis GROUP BY 1, 2, 3"""),
    "pair_shifted": (pair_shifted, f"""WITH {SIGNALS.replace('signals AS', 'raw AS')}, signals AS (SELECT source_id, axis, idx, CASE WHEN axis = 'view' THEN t - 7.5::DOUBLE ELSE t END AS t, value FROM raw), {GRID}, {PAIRS}
        SELECT source_id, count(*) AS n, round(sqrt(avg((b - a)^2)), 5) AS rmse, round(avg(b - a), 5) + 0.0 AS bias FROM pairs GROUP BY 1"""),
    "coherence_evaluated": (coherence_evaluated, f"""WITH e AS ({COHERENCE.replace('round(bin / (16 * ' + str(STEP) + '::DOUBLE), 5) AS frequency', 'bin / (16 * ' + str(STEP) + '::DOUBLE) AS frequency').replace('round((re * re', '((re * re').replace(', 0), 5) AS coherence', ', 0)) AS coherence')})
        SELECT source_id, round(arg_min(coherence, (round(abs(frequency - 0.03::DOUBLE), 9), bin)), 4) AS at_target, round(avg(coherence) FILTER (abs(frequency - 0.03::DOUBLE) <= 0.012::DOUBLE), 4) AS near_mean, round(max(coherence) FILTER (abs(frequency - 0.03::DOUBLE) <= 0.012::DOUBLE), 4) AS near_max,
        round(avg(coherence) FILTER (frequency BETWEEN 0.01::DOUBLE AND 0.06::DOUBLE), 4) AS band_mean, round(max(coherence) FILTER (frequency BETWEEN 0.01::DOUBLE AND 0.06::DOUBLE), 4) AS band_max, count(*) FILTER (frequency BETWEEN 0.01::DOUBLE AND 0.06::DOUBLE) AS band_bins FROM e GROUP BY 1"""),
    "psd_peaks": (psd_peaks, f"""WITH e AS ({COHERENCE.replace('round(bin / (16 * ' + str(STEP) + '::DOUBLE), 5) AS frequency', 'bin / (16 * ' + str(STEP) + '::DOUBLE) AS frequency').replace('round(aa *', '(aa *').replace('END, 5) AS psd_a', 'END) AS psd_a')}),
        n AS (SELECT *, lag(psd_a) OVER w AS lo, lead(psd_a) OVER w AS hi FROM e WINDOW w AS (PARTITION BY source_id ORDER BY bin)),
        p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(psd_a, 9) DESC, bin) AS rank FROM n WHERE psd_a > lo AND psd_a >= hi) SELECT source_id, rank, round(frequency, 5) AS frequency FROM p WHERE rank <= 10"""),
    "harmonics_compared": (harmonics_compared, f"{HARMONICS} SELECT source_id, axis, harmonic, round(reference, 5) AS reference, round(amplitude, 5) AS amplitude, round(error, 5) AS error, observable, preserved FROM cmp"),
    "harmonics_preserved": (harmonics_preserved, f"""{HARMONICS} SELECT axis, count(*) AS harmonics, count(*) FILTER (observable) AS observable, count(*) FILTER (preserved) AS preserved, round(100.0 * count(*) FILTER (observable) / count(*), 5) AS observable_percent, round(100.0 * count(*) FILTER (preserved) / count(*), 5) AS preserved_percent FROM cmp GROUP BY 1"""),
    "envelope_normalised": (envelope_normalised, f"""WITH {SIGNALS}, {GRID}, g AS (SELECT source_id, axis, k, abs(value) AS value, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_id, axis) AS n FROM grid WINDOW w AS (PARTITION BY source_id, axis ORDER BY k)),
        s AS (SELECT source_id, axis, quantile_cont(value, 0.5) FILTER (i <= greatest(3, round_even(0.05::DOUBLE * n, 0))) AS scale, max(value) AS top FROM g GROUP BY 1, 2)
        SELECT source_id, axis, k, round(value / CASE WHEN scale > 2.220446049250313e-16::DOUBLE THEN scale WHEN top > 2.220446049250313e-16::DOUBLE THEN top END, 5) AS value FROM g JOIN s USING (source_id, axis)"""),
}
