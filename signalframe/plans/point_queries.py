"""Queries over tracked points and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.functions.scalars import percent
from signalframe.operators import filters, motion
from signalframe.operators.blocks import percentiles
from signalframe.plans.adapters import DETECTIONS, POINTS, detections, points


def rounded(df, digits=4):
    """All doubles rounded, negative zero made plain, for comparisons."""
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


GOOD = "good AS (SELECT * FROM points WHERE status = 1 AND fb_error <= 0.8 AND jump_px <= 20)"
MOVED = """refs AS (SELECT point_id, quantile_cont(x, 0.5) AS ref_x, quantile_cont(y, 0.5) AS ref_y, count(*) AS ref_n
  FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY frame) AS rn FROM good) WHERE rn <= 20 GROUP BY 1),
moved AS (SELECT good.*, x - ref_x AS ux, y - ref_y AS uy, sqrt((x - ref_x)^2 + (y - ref_y)^2) AS u, ref_n FROM good JOIN refs USING (point_id))"""
BY_FRAME = """by_frame AS (SELECT frame, t, count(DISTINCT point_id) AS n_points,
  quantile_cont(x, 0.5) AS med_x, quantile_cont(y, 0.5) AS med_y, quantile_cont(ux, 0.5) AS med_ux, quantile_cont(uy, 0.5) AS med_uy,
  quantile_cont(dx, 0.5) AS med_dx, quantile_cont(dy, 0.5) AS med_dy, quantile_cont(jump_px, 0.5) AS med_jump_px, quantile_cont(fb_error, 0.5) AS med_fb_error,
  max(jump_px) AS max_jump, max(fb_error) AS max_fb, stddev_samp(uy) AS std_uy, max(uy) - min(uy) AS range_uy
  FROM moved GROUP BY 1, 2 HAVING count(DISTINCT point_id) >= 2)"""


def good(spark, sf):
    return filters.good_points(points(spark, sf), max_fb=0.8)


def moved(spark, sf):
    rows = good(spark, sf)
    return motion.displaced(rows, motion.references(rows))


def frame_robust_aggregate(spark, sf):
    return rounded(motion.by_frame(moved(spark, sf)), 6)


def point_quality_filter(spark, sf):
    return rounded(filters.good_points(points(spark, sf), 0.5, 0.09, [1, 2, 3]).select("frame", "point_id", "x", "y", "jump_px", "fb_error"))


def point_gate(spark, sf):
    rows = filters.gated(points(spark, sf), 0.08, 0.6)
    return rounded(rows.groupBy("point_id").agg(F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum("dx").alias("sum_dx"), F.sum("dy").alias("sum_dy")))


def point_displacements(spark, sf):
    return rounded(moved(spark, sf).select("frame", "point_id", "ux", "uy", "u", "ref_n"), 6)


def point_diagnostics_wide(spark, sf):
    return rounded(motion.diagnostics(good(spark, sf), [1, 2, 3], ("y", "fb_error")))


def point_statistics(spark, sf):
    return rounded(motion.point_statistics(points(spark, sf), filters.good_test(max_fb=0.8)))


def point_motion_summary(spark, sf):
    rows = points(spark, sf)
    return rounded(motion.motion_summary(motion.displaced(rows, motion.references(good(spark, sf)))), 3)


def point_run_summary(spark, sf):
    return rounded(motion.run_summary(points(spark, sf), motion.by_frame(moved(spark, sf))))


def moving_points(spark, sf):
    rows = filters.moving(points(spark, sf), 0.07)
    return rounded(rows.groupBy("frame").agg(F.count("*").alias("n"), F.avg(F.hypot("dx", "dy")).alias("mean_magnitude")))


def rule_query(name):
    def run(spark, sf):
        return rounded(filters.by_rule(detections(spark, sf), filters.RULES[name]).select("frame", "object_id", "area", "w", "h"))

    return run


def rule_sql(name):
    r = filters.RULES[name]
    top = "" if r.most_height is None else f"AND h <= {r.most_height}"
    keep = "" if r.keep is None else f"WHERE n <= {r.keep}"
    return f"""WITH {DETECTIONS} SELECT frame, object_id, round(area, 4) AS area, w, h FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, object_id) AS n
      FROM detections WHERE area >= {r.area} AND w / h >= {r.aspect} AND w >= {r.width} AND h >= {r.height} {top}) {keep}"""


def component_refined(spark, sf):
    return rounded(filters.refined(detections(spark, sf), 100, 30, 8))


def detection_boxes(spark, sf):
    rows = filters.boxes(detections(spark, sf).where("score >= 0.5"))
    return rounded(rows.select("object_id", "cx", "cy", "x2", "y2", "box_area"))


def bed_detection(spark, sf):
    rows = detections(spark, sf).where(F.lower("class_id").contains("low"))
    return rounded(rows.groupBy("frame").agg(F.max_by("object_id", F.struct("area", "object_id")).alias("object_id"), F.max("area").alias("area")))


def detector_summary(spark, sf):
    rows = detections(spark, sf)
    objects = rows.groupBy("class_id").agg(
        F.count("*").alias("objects"), F.count_distinct("frame").alias("frames"), F.avg("score").alias("mean_score")
    )
    scores = percentiles(rows, ["class_id"], ["score"], [0.5, 0.95]).select("class_id", F.col("score")[0].alias("med_score"), F.col("score")[1].alias("p95_score"))
    objects = objects.join(scores, "class_id", "left")
    return rounded(objects.withColumn("per_frame", F.col("objects") / F.col("frames")))


def detector_frames(spark, sf):
    from signalframe.plans.adapters import table

    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"))
    counts = detections(spark, sf).where("score >= 0.6").groupBy("frame").agg(F.count("*").alias("n_detections"))
    out = frames.join(counts, "frame", "left").withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))
    return out.withColumn("has_detection", (F.col("n_detections") > 0).cast("int"))


def detection_rates(spark, sf):
    rows = detector_frames(spark, sf)
    one = rows.agg(F.count("*").alias("frames"), F.sum("has_detection").alias("detected"), F.sum("n_detections").alias("objects"))
    return rounded(one.withColumn("rate", percent(F.col("detected"), F.col("frames"))))


FRAMES = """frames AS (SELECT c_custkey AS frame, coalesce(n, 0) AS n_detections, (coalesce(n, 0) > 0)::INT AS has_detection
  FROM customer LEFT JOIN (SELECT frame, count(*) AS n FROM detections WHERE score >= 0.6 GROUP BY 1) d ON d.frame = c_custkey)"""

QUERIES = {
    "frame_robust_aggregate": (frame_robust_aggregate, f"""WITH {POINTS}, {GOOD}, {MOVED}, {BY_FRAME} SELECT frame, round(t, 6) AS t, n_points,
        {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('med_x', 'med_y', 'med_ux', 'med_uy', 'med_dx', 'med_dy', 'med_jump_px', 'med_fb_error', 'max_jump', 'max_fb', 'std_uy', 'range_uy'))},
        round(sqrt(med_ux^2 + med_uy^2), 6) AS med_u FROM by_frame"""),
    "point_quality_filter": (point_quality_filter, f"WITH {POINTS} SELECT frame, point_id, round(x, 4) AS x, y, round(jump_px, 4) AS jump_px, round(fb_error, 4) AS fb_error FROM points WHERE status = 1 AND fb_error <= 0.5 AND jump_px <= 0.09 AND point_id IN (1, 2, 3)"),
    "point_gate": (point_gate, f"""WITH {POINTS}, g AS (SELECT *, status = 1 AND jump_px <= 0.08 AND fb_error <= 0.6 AS ok FROM points)
        SELECT point_id, sum(ok::BIGINT)::BIGINT AS accepted, round(sum(CASE WHEN ok THEN dx ELSE 0 END), 4) AS sum_dx, round(sum(CASE WHEN ok THEN dy ELSE 0 END), 4) AS sum_dy FROM g GROUP BY 1"""),
    "point_displacements": (point_displacements, f"WITH {POINTS}, {GOOD}, {MOVED} SELECT frame, point_id, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, round(u, 6) AS u, ref_n FROM moved"),
    "point_diagnostics_wide": (point_diagnostics_wide, f"""WITH {POINTS}, {GOOD} SELECT frame, round(t, 4) AS t, {', '.join(f'round(max(CASE WHEN point_id = {i} THEN {m} END), 4) AS p{i}_{m}' for i in (1, 2, 3) for m in ('y', 'fb_error'))} FROM good GROUP BY frame, t"""),
    "point_statistics": (point_statistics, f"""WITH {POINTS}, {GOOD} SELECT a.point_id, n_rows, first_frame, last_frame, coalesce(n_valid, 0) AS n_valid, round(med_fb, 4) AS med_fb, round(max_fb, 4) AS max_fb, round(med_jump, 4) AS med_jump,
        round(max_jump, 4) AS max_jump, round(coalesce(n_valid, 0) / n_rows, 4) AS valid_share
        FROM (SELECT point_id, count(*) AS n_rows, min(frame) AS first_frame, max(frame) AS last_frame FROM points GROUP BY 1) a
        LEFT JOIN (SELECT point_id, count(*) AS n_valid, quantile_cont(fb_error, 0.5) AS med_fb, max(fb_error) AS max_fb, quantile_cont(jump_px, 0.5) AS med_jump, max(jump_px) AS max_jump FROM good GROUP BY 1) b USING (point_id)"""),
    "point_motion_summary": (point_motion_summary, f"""WITH {POINTS}, {GOOD}, {MOVED}, d AS (SELECT points.*, y - ref_y AS uy FROM points JOIN refs USING (point_id))
        SELECT point_id, round(avg(status), 3) AS success, round((max(uy) FILTER (status = 1) - min(uy) FILTER (status = 1)) / 2, 3) AS amplitude, round(sqrt(avg(uy * uy) FILTER (status = 1)), 3) AS rms,
        round(avg(uy) FILTER (status = 1), 3) AS mean_uy, round(avg(jump_px) FILTER (status = 1), 3) AS mean_jump FROM d GROUP BY 1"""),
    "point_run_summary": (point_run_summary, f"""WITH {POINTS}, {GOOD}, {MOVED}, {BY_FRAME} SELECT n_frames, n_kept, round(first_t, 4) AS first_t, round(last_t, 4) AS last_t, round(mean_points, 4) AS mean_points, round(n_kept / n_frames, 4) AS kept_share
        FROM (SELECT count(DISTINCT frame) AS n_frames FROM points), (SELECT count(*) AS n_kept, min(t) AS first_t, max(t) AS last_t, avg(n_points) AS mean_points FROM by_frame)"""),
    "moving_points": (moving_points, f"WITH {POINTS} SELECT frame, count(*) AS n, round(avg(sqrt(dx^2 + dy^2)), 4) AS mean_magnitude FROM points WHERE abs(dx) > 0.07 OR abs(dy) > 0.07 GROUP BY 1"),
    **{f"components_{name}": (rule_query(name), rule_sql(name)) for name in filters.RULES},
    "component_refined": (component_refined, f"""WITH {DETECTIONS} SELECT frame, object_id, round(area, 4) AS area, w, h, round(area / (w * h), 4) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, object_id) AS n
        FROM detections WHERE area >= 100 AND w >= 30 AND h >= 8) WHERE n = 1"""),
    "detection_boxes": (detection_boxes, f"WITH {DETECTIONS} SELECT object_id, x + w / 2 AS cx, y + h / 2 AS cy, x + w AS x2, y + h AS y2, w * h AS box_area FROM detections WHERE score >= 0.5"),
    "bed_detection": (bed_detection, f"WITH {DETECTIONS} SELECT frame, arg_max(object_id, (area, object_id)) AS object_id, max(area) AS area FROM detections WHERE lower(class_id) LIKE '%low%' GROUP BY 1"),
    "detector_summary": (detector_summary, f"""WITH {DETECTIONS} SELECT class_id, count(*) AS objects, count(DISTINCT frame) AS frames, round(avg(score), 4) AS mean_score, round(quantile_cont(score, 0.5), 4) AS med_score,
        round(quantile_cont(score, 0.95), 4) AS p95_score, round(count(*) / count(DISTINCT frame), 4) AS per_frame FROM detections GROUP BY 1"""),
    "detector_frames": (detector_frames, f"WITH {DETECTIONS}, {FRAMES} SELECT * FROM frames"),
    "detection_rates": (detection_rates, f"WITH {DETECTIONS}, {FRAMES} SELECT count(*) AS frames, sum(has_detection)::BIGINT AS detected, sum(n_detections)::BIGINT AS objects, round(100.0::DOUBLE * sum(has_detection) / count(*), 4) AS rate FROM frames"),
}
