import re

import pytest
from pyspark.sql import functions as F

from signalframe.operators import masks, summaries
from signalframe.plans import queries as base


def test_runs_with_and_without_frames(spark):
    frames = spark.createDataFrame([("a", 0, 1, 0.1), ("a", 1, 0, 0.3), ("a", 2, 1, 0.2), ("c", 0, 0, None)], "run string, frame int, has_detection int, compute_time double")
    objects = spark.createDataFrame([("a", 0.5, 10.0), ("a", 0.7, None), ("a", 0.9, 20.0)], "run string, score double, area double")
    rows = {r.run: r for r in summaries.detector_run(frames, objects, ["run"]).collect()}
    a, c = rows["a"], rows["c"]
    assert (a.processed, a.with_detections, a.without_detections, a.objects, a.median_score, a.mean_area) == (3, 2, 1, 3, 0.7, 15.0)
    assert (a.median_time, a.fps) == (pytest.approx(0.2), pytest.approx(5.0)) and a.p95_time == pytest.approx(0.29)
    assert (c.processed, c.output_rate, c.objects, c.fps, c.mean_score) == (1, 0.0, 0, None, None)
    runs = spark.createDataFrame([("a", 3, 0, 3, 1.5), ("b", 5, 0, 5, 1.0), ("c", 4, 3, 4, 0.0)], "run string, source_frames long, start_frame long, end_frame long, runtime double")
    out = {r.run: (r.expected, r.processed, r.coverage, r.output_rate, r.fps, r.full_length) for r in summaries.benchmark_row(runs, frames, ["run"]).collect()}
    assert out == {"a": (3, 3, 100.0, pytest.approx(200 / 3), 2.0, True), "b": (5, 0, 0.0, None, None, False), "c": (1, 1, 100.0, 0.0, None, False)}


@pytest.mark.parametrize("span", [0.5, 3.0, 1000.0])
def test_time_base_in_slices(spark, span):
    times = [0.0, 0.25, 0.5, 1.0, 7.0, 7.25]
    df = spark.createDataFrame([("r", t) for t in times], "run string, t double")
    row = summaries.time_base(df, ["run"], span).first()
    assert (row.median_step, row.fps) == (0.25, 4.0)


def test_verdicts_of_points(spark):
    rows = [(1, float(i), 10.0 + i % 3, 5.0 - i % 2, 1.0, 1) for i in range(12)] + [(1, 12.0, 99.0, 99.0, 9.0, 0)]
    rows += [(2, float(i), 1.0, 1.0, 4.0, 1) for i in range(12)] + [(3, float(i), 1.0, 1.0, 1.0, 1) for i in range(9)] + [(4, 0.0, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "point_id int, t double, x double, y double, jump_px double, status int")
    dominant = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.2)], "point_id int, frequency double")
    found = {r.point_id: r for r in summaries.point_motion(df, dominant).collect()}
    one = found[1]
    assert (one.amp_x, one.amp_y, one.total_samples, one.num_samples, one.valid, one.reason, one.max_jump) == (1.0, 0.5, 13, 12, True, "ok", 1.0)
    assert (found[2].valid, found[2].reason) == (False, "low_quality_tracking")
    assert (found[3].reason, found[3].amp_x, found[3].dominant) == ("too_few_valid_samples", None, None)
    assert (found[4].reason, found[4].success_rate) == ("too_few_valid_samples", 0.0)


def test_what_lies_beside_a_frame(spark):
    frames = spark.createDataFrame([(f,) for f in (1, 2, 5)], "frame int")
    objects = spark.createDataFrame([(1, 9, "b"), (1, 8, "a"), (5, 7, "c"), (6, 6, "d")], "frame int, object int, label string")
    found = {r.frame: [tuple(o) for o in r.objects] for r in summaries.objects_by_frame(frames, objects, ["frame"], ["object", "label"]).collect()}
    assert found == {1: [(8, "a"), (9, "b")], 2: [], 5: [(7, "c")]}
    trail = sorted((r["at"], r.frame, r.object) for r in summaries.trails(objects, [], 2).collect())
    assert trail == [(1, 1, 8), (1, 1, 9), (5, 5, 7), (6, 5, 7), (6, 6, 6)]
    flags = {r.frame: (r.found_a, r.found_b, r.missing) for r in summaries.manifest(frames, "frame", a=objects, b=frames.where("frame = 2")).collect()}
    assert flags == {1: (True, False, "b"), 2: (False, True, "a"), 5: (True, False, "b")}


def test_normalisations_by_name(spark):
    df = spark.createDataFrame([("s", "a", i, float(v)) for i, v in enumerate([1, 2, 6])], "source_id string, axis string, idx int, value double")
    value = lambda name: [r.normalised for r in summaries.normalised(df, name).orderBy("idx").collect()]
    assert value("None") == [1.0, 2.0, 6.0] and value("minmax") == [0.0, 0.2, 1.0] and value("ZScore")[0] == pytest.approx(-2 / (14 / 3) ** 0.5)
    with pytest.raises(ValueError, match="unknown"):
        summaries.normalised(df, "l2")


def test_region_and_gate_of_masks(spark):
    df = spark.createDataFrame([(f, y, x, 200 if y >= 3 + f else 10) for f in range(2) for y in range(8) for x in range(4)], "frame int, y int, x int, v int")
    assert {r.frame: r.mean_v for r in masks.brightness(df, (1, 3, 2, 2)).collect()} == {0: 200.0, 1: 105.0}
    assert {r.frame: (r.edge, r.success) for r in masks.edge_rows(df, 3.0, 2.0, 3, 10.0).collect()} == {0: (2, True), 1: (3, True)}  # ties go to the upper row
    assert all(r.edge is None and not r.success for r in masks.edge_rows(df, 3.0, 2.0, 7, 1e4).collect())


def test_masks_of_consecutive_frames(spark):
    masks_of = {(1, "a"): {0, 63, 64, 700}, (2, "a"): {63, 64, 65}, (3, "a"): set(), (4, "a"): set(), (6, "a"): {1}, (1, "b"): {5}, (2, "b"): {5}, (3, "b"): {5}}
    frames = spark.createDataFrame(list(masks_of), "frame long, mode string")
    on = spark.createDataFrame([(*k, p) for k, px in masks_of.items() for p in [*px, *px]], "frame long, mode string, px int")  # each pixel twice
    found = masks.temporal_overlap(frames, on, ["mode"], ["mode"])
    assert {r["mode"]: (r.pairs, round(r.mean_iou, 9)) for r in found.collect()} == {"a": (3, round((2 / 5 + 0 + 1) / 3, 9)), "b": (2, 1.0)}
    one = masks.temporal_overlap(frames.where("mode = 'a'"), on.where("mode = 'a'"), ["mode"]).first()
    assert (one.pairs, round(one.mean_iou, 9)) == (3, round((2 / 5 + 0 + 1) / 3, 9))


def test_edges_of_several_images_a_frame(spark):
    df = spark.createDataFrame([(0, m, y, x, 200 if y >= 3 + m else 10) for m in range(2) for y in range(8) for x in range(4)], "frame int, mode int, y int, x int, v int")
    assert {(r.frame, r["mode"]): r.edge for r in masks.edge_rows(df, 3.0, 2.0, by=["mode"]).collect()} == {(0, 0): 2, (0, 1): 3}


def test_pixels_of_colour_modes_stay_where_their_frame_is(spark):
    plan = base.queries()["colour_modes_compared"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("REPARTITION_BY_NUM" in line for line in deals) and not any(re.search(r"\b(x|y|px|v)#", line) for line in deals)


def test_labels_of_agreement(spark):
    rows = [(True, True, 1.0, 1.0, 1.0), (None, False, 1.0, 1.0, 1.0), (False, True, None, 1.0, 1.0), (False, True, 10.0, 5.0, 0.8), (False, True, 10.0, 5.0, 0.6), (False, True, 10.0, 5.0, None), (False, True, 60.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "f boolean, d boolean, a double, e double, c double").coalesce(1)
    found = [r.l for r in df.select(summaries.physical_agreement(*[F.col(c) for c in "fdaec"]).alias("l")).collect()]
    assert found == ["analysis_failed", "decay_not_confirmed", "insufficient_metrics", "strong_physical_agreement", "moderate_physical_agreement", "weak_physical_agreement", "no_physical_agreement"]
    df = spark.createDataFrame([(0.7,), (0.4,), (0.2,), (0.1,), (None,)], "c double").coalesce(1)
    assert [r.l.split("_")[0] for r in df.select(summaries.time_similarity(F.col("c")).alias("l")).collect()] == ["strong", "moderate", "weak", "no", "validation"]
