import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalframe.operators import blocks, filtering, filters, masks, matching, motion, series, spectral
from signalframe.streaming import trackers

SERIES = "source_id string, axis string, idx long, t double, value double"


def uniform(spark, values, step=1.0):
    return spark.createDataFrame([("s", "a", i, i * step, float(v)) for i, v in enumerate(values)], SERIES)


def ordered(df, column, by="idx"):
    return np.array([r[column] if r[column] is not None else np.nan for r in df.orderBy(by).collect()], float)


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=n)


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_blocks_equal_whole_series(spark, size):
    x = noise(120)
    df = uniform(spark, x)
    keys = ["source_id", "axis"]
    mean = blocks.moving_window(df, keys, "idx", 3, 2, {"m": (F.avg, F.col("value"))}, size=size)
    assert np.allclose(ordered(mean, "m"), [x[max(0, i - 3) : i + 3].mean() for i in range(120)])
    assert np.allclose(ordered(blocks.cumulative(df, keys, "idx", "value", "c", size=size), "c"), np.cumsum(x))
    smooth = ordered(filtering.dot(df, keys, "idx", "value", filtering.savitzky_golay(7, 3), "s", size=size), "s")
    assert np.isnan(smooth[:3]).all() and np.allclose(smooth[3:-3], np.convolve(x, filtering.savitzky_golay(7, 3)[::-1], "valid"))


def test_first_rows_of_a_hot_key(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("f"))
    assert sorted(r.f for r in blocks.first_rows(df, ["k"], [F.col("f")], 20).collect()) == list(range(20))


def test_savitzky_golay_is_exact_for_cubics():
    t = np.arange(-30, 31) * 0.5
    for d, value in ((0, 2.0), (1, -1.0), (2, 6.0)):
        weights = np.array(filtering.savitzky_golay(61, 3, d, 0.5))
        assert weights @ (2 - t + 3 * t**2 + 0.5 * t**3) == pytest.approx(value, abs=1e-7)


def test_low_pass_keeps_slow_and_drops_fast():
    weights = np.array(filtering.low_pass(101, 0.05))
    at = np.arange(101)
    gain = lambda f: abs((weights * np.exp(-2j * np.pi * f * at)).sum())
    assert gain(0) == pytest.approx(1) and gain(0.02) > 0.98 and gain(0.1) < 0.01


@pytest.mark.parametrize(("low", "high"), [(None, 0.1), (0.02, 0.2)])
def test_butterworth_gain_and_blocks(spark, low, high):
    sections = filtering.butterworth(4, low, high)
    gain = lambda f: abs(np.prod([np.polyval(b[::-1], np.exp(-2j * np.pi * f)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f)) for b, a in sections]))
    assert gain(high) == pytest.approx(math.sqrt(0.5), abs=0.02) and gain(0.45) < 0.01
    assert low is None or (gain(low) == pytest.approx(math.sqrt(0.5), abs=0.02) and gain(1e-6) < 1e-6)
    x = np.sin(np.arange(900) * 0.4) + noise(900)
    df = uniform(spark, x)
    found = ordered(filtering.filtered(df, ["source_id", "axis"], "idx", "value", 4, low, high, size=200), "filtered")
    assert np.abs(found - filtering.zero_phase(x, sections)).max() < 1e-5


def test_envelope_of_a_modulated_tone(spark):
    i = np.arange(400)
    level = 1 + 0.5 * np.sin(2 * np.pi * i / 400)
    found = ordered(filtering.envelope(uniform(spark, level * np.cos(2 * np.pi * 0.2 * i)), ["source_id", "axis"], "idx", "value"), "envelope")
    assert np.nanmax(np.abs(found - level)) < 0.02 and np.isnan(found[:31]).all()


def test_prominent_peaks(spark):
    x = [0, 3, 1, 5, 4.5, 4.8, 0, 0.2, 0, 2, 0]
    found = filtering.prominent_peaks(uniform(spark, x), ["source_id", "axis"], "idx", "value", 1.0, 10, 2)
    assert sorted((r.idx, round(r.prominence, 6)) for r in found.collect()) == [(1, 2.0), (3, 5.0), (9, 2.0)]


def test_resampling_and_gradient(spark):
    t = np.sort(np.random.default_rng(2).uniform(0, 50, 80))
    df = spark.createDataFrame([("s", "a", i, float(a), float(3 * a + 1)) for i, a in enumerate(t)], SERIES)
    grid = series.resampled(df, 0.5).orderBy("k").collect()
    assert [r.k for r in grid] == list(range(math.ceil(t[0] / 0.5), math.ceil(t[-1] / 0.5)))
    assert all(r.value == pytest.approx(3 * r.t + 1) for r in grid)
    assert np.allclose(ordered(series.gradient(df), "slope"), 3)


def test_ema_is_the_recurrence(spark):
    x, want = noise(200), []
    for v in x:
        want.append(v if not want else 0.7 * want[-1] + 0.3 * v)
    assert np.allclose(ordered(series.ema(uniform(spark, x), 0.3), "ema"), want, atol=1e-6)


@pytest.mark.parametrize("shift", [-3, 0, 4])
def test_lag_of_a_shifted_copy(spark, shift):
    x = noise(80, 5)
    pairs = spark.createDataFrame([(1, i, float(x[i + 10]), float(x[i + 10 - shift])) for i in range(60)], "id int, k long, a double, b double")
    products = series.lag_products(pairs, ["id"], 6)
    best = series.best_lag(products, ["id"], True).first()
    assert best.lag == shift
    assert series.pair_metrics(series.aligned(pairs, series.best_lag(products, ["id"], False), ["id"]), ["id"]).first().rmse == pytest.approx(0)


def test_spectrum_matches_fft(spark):
    n = 64
    x = 2 + np.sin(2 * np.pi * 5 * np.arange(n) / n) + 0.1 * noise(n)
    grid = uniform(spark, x).withColumnRenamed("idx", "k").drop("t")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    want = np.abs(np.fft.rfft((x - x.mean()) * w)) / w.sum()
    want[1:-1] *= 2
    found = spectral.spectrum(spectral.prepared(grid), 0.1, 0.0, 5.0)
    assert np.allclose(ordered(found, "amplitude", "bin"), want)
    assert spectral.dominant(found).first().frequency == pytest.approx(5 / 6.4)


def test_coherence_of_a_series_with_itself_is_one(spark):
    x = noise(64, 8)
    pairs = spark.createDataFrame([(1, i, float(v), float(2 * v)) for i, v in enumerate(x)], "id int, k long, a double, b double")
    rows = spectral.coherence(pairs, 16, 1.0, ["id"]).collect()
    assert len(rows) == 8 and all(r.coherence == pytest.approx(1) and r.segments == 7 for r in rows)


def test_edges_of_series(spark):
    empty = uniform(spark, [])
    assert series.statistics(empty).count() == 0 and series.resampled(empty, 1.0).count() == 0
    flat = uniform(spark, [4.0])
    assert series.zscore(flat).first().z == 4 and series.minmax(flat).first().unit == 4 and series.robust(flat).first().robust == 4
    odd = spark.createDataFrame([("s", "a", 0, 1.0, float("nan")), ("s", "a", 1, 1.0, 2.0), ("s", "a", 2, 1.0, 3.0), ("s", "a", 3, None, 3.0), ("s", "a", 4, 0.5, float("inf"))], SERIES)
    assert [(r.t, r.value) for r in series.clean(odd).collect()] == [(1.0, 2.0)]


def test_interval_join_matches_all_pairs(spark):
    r = random.Random(1)
    left = [(i, s := r.uniform(0, 500), s + r.uniform(0, 90)) for i in range(60)]
    right = [(i, s := r.uniform(0, 500), s + r.uniform(0, 40)) for i in range(20)]
    a, b = spark.createDataFrame(left, "m int, start double, end double"), spark.createDataFrame(right, "w int, window_start double, window_end double")
    found = {(x.m, x.w): (x.overlap, x.gap) for x in matching.interval_join(a, b, 10.0, 37.0).collect()}
    want = {}
    for i, s, e in left:
        for j, p, q in right:
            gap = max(0.0, p - e, s - q)
            if gap <= 10:
                want[i, j] = (max(0.0, min(e, q) - max(s, p)), gap)
    assert found == want


def test_roi_rules_and_requirements(spark):
    assert filters.clamp((-5, 3, 20, 40), 10, 12) == (0, 3, 10, 9)
    with pytest.raises(ValueError, match="missing columns: b"):
        filters.require(spark.range(1).withColumnRenamed("id", "a"), "a", "b")
    rows = spark.createDataFrame([(1, 1, 200.0, 90, 10), (1, 2, 300.0, 90, 10), (1, 3, 900.0, 90, 80)], "frame int, object_id int, area double, w int, h int")
    assert [r.object_id for r in filters.by_rule(rows, filters.RULES["inner_pipe"]).collect()] == [2]


def test_mask_overlap_of_empty_sides(spark):
    some = spark.createDataFrame([(1, 0), (1, 1), (2, 5)], "frame int, px int")
    found = {r.frame: (r.tp, r.fp, r.fn, r.iou) for r in masks.overlap_counts(some, some.where("frame = 1"), 64).collect()}
    assert found == {1: (2, 0, 0, 1.0), 2: (0, 0, 1, 0.0)}


def test_references_use_the_first_valid_rows(spark):
    rows = spark.createDataFrame([(f, 1, float(f), 0.0) for f in range(100, 0, -1)], "frame int, point_id int, x double, y double")
    assert motion.references(rows, 20).first().ref_x == pytest.approx(10.5)


def test_frames_meet_references_where_they_lie(spark):
    none, nan = None, float("nan")
    rows = [(f, f / 2, i, x, float(i), 0.1, none, 0.0, nan if i else 1.0) for f, xs in enumerate([[3.0, 1.0, 8.0], [2.0, 9.0, none, 4.0, 6.0], [5.0]]) for i, x in enumerate(xs)]
    df = spark.createDataFrame([*rows, rows[0]], "frame int, t double, point_id int, x double, y double, dx double, dy double, jump_px double, fb_error double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = motion.by_frame(motion.displaced(df, motion.references(df)))
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = {r.frame: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no task holds all rows of a point
    assert {f: (r.n_points, r.med_x, r.med_y, r.med_dy) for f, r in found.items()} == {0: (3, 3.0, 0.5, none), 1: (5, 5.0, 2.0, none)}
    assert math.isnan(found[1].med_fb_error) and found[0].med_dx == 0.1


def moving_object(frames, gap=(), speed=3.0):
    return [("v", f, None if f in gap else 10 + speed * f, None if f in gap else 20.0, 100.0) for f in range(frames)]


DETECTED = "video string, frame long, x double, y double, area double"


def test_filter_of_numbers_equals_that_of_matrices():
    move, see = np.array([[1.0, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]]), np.eye(2, 4)
    state, cover, found = np.array([3.0, 7.0, 0.0, 0.0]), np.eye(4) * 10.0, trackers.Kalman(3.0, 7.0)
    for i, (x, y) in enumerate(zip(noise(80, 1) * 9, noise(80, 2) * 9, strict=True)):
        state, cover = move @ state, move @ cover @ move.T + np.eye(4) * 0.01
        found.predict()
        if i % 7 > 2:
            gain = cover @ see.T @ np.linalg.inv(see @ cover @ see.T + np.eye(2) * 5.0)
            state, cover = state + gain @ (np.array([x, y]) - see @ state), (np.eye(4) - gain @ see) @ cover
            found.update(float(x), float(y))
        assert np.allclose(found.numbers(), [*state, cover[0, 0], cover[0, 2], cover[2, 2]], rtol=1e-9, atol=1e-9)


def test_single_tracker_coasts_and_loses(spark):
    df = spark.createDataFrame(moving_object(60, set(range(20, 25)) | set(range(40, 55))), DETECTED)
    found = {r.frame: (r.x, r.missed) for r in trackers.track(df, ["video"], trackers.Single).collect()}
    assert found[24][1] == 5 and found[24][0] == pytest.approx(82, abs=3)
    assert 49 in found and 50 not in found and found[55][0] == pytest.approx(175, abs=0.5) and found[55][1] == 0


def test_multi_tracker_keeps_identities(spark):
    rows = [("v", f, 10.0 + 2 * f, 10.0, 1.0) for f in range(30)] + [("v", f, 300.0 - 2 * f, 200.0, 1.0) for f in range(30) if f not in (10, 11)]
    found = trackers.track(spark.createDataFrame(rows, DETECTED), ["video"], trackers.Multi).collect()
    assert {r.track_id for r in found} == {1, 2} and len(found) == 60
    late = trackers.track(spark.createDataFrame(rows, DETECTED), ["video"], trackers.Multi, chunk=10)
    assert sorted(late.collect()) == sorted(found)


def recording(frames=400):
    """Walkers that come, stay for long and go, two of them over most of the recording, some frames without any."""
    rng = np.random.default_rng(8)
    rows = []
    for video in ("v", None):
        starts = [(0, frames, 20.0, 30.0, 1.5, 0.4)] + [(int(rng.integers(0, frames)), int(rng.integers(1, 150)), *rng.uniform(0, 900, 2), *rng.uniform(-3, 3, 2)) for _ in range(25)]
        for f in range(frames):
            seen = [(float(x + vx * (f - s) + rng.normal()), float(y + vy * (f - s) + rng.normal()), float(rng.uniform(1, 9))) for s, n, x, y, vx, vy in starts if s <= f < s + n and rng.random() > 0.05]
            seen = [] if f % 97 < 3 or 210 <= f < 225 else seen
            rows += [(video, f, *d) for d in seen] or [(video, f, None, None, None)]
    return rows


@pytest.mark.parametrize("machine", [trackers.Single, trackers.Multi, trackers.Smoother, trackers.Deflicker])
def test_tracks_do_not_depend_on_chunks(spark, machine):
    rows = recording()
    df = spark.createDataFrame(rows, DETECTED)
    want = []
    for video in ("v", None):
        part = pd.DataFrame([r[1:] for r in rows if r[0] == video], columns=["frame", "x", "y", "area"])
        want += [(video or "", r.frame, r.track_id, round(r.x, 6)) for r in trackers.advance(machine(), part).itertuples()]
    for chunk, warm_up in ((50, 20), (200, 512), (100_000, 0)):
        found = [(r.video or "", r.frame, r.track_id, round(r.x, 6)) for r in trackers.track(df, ["video"], machine, chunk, warm_up).collect()]
        assert sorted(found) == sorted(want)


def test_deflicker_gain_is_steady():
    i = np.arange(400)
    x = 100 + 10 * np.cos(2 * np.pi * 0.25 * i)
    out = trackers.advance(trackers.Deflicker(), pd.DataFrame({"frame": i, "x": x, "y": 0.0, "area": 0.0}))
    assert np.abs(out.y.to_numpy(float)[300:] - (x[300:] - 100)).max() < 1e-9
    assert np.abs(out.x.to_numpy()[300:] * x[300:] - 110).max() < 1.6  # the target is the first brightness less the flicker, smoothed


@pytest.mark.parametrize("machine", [trackers.Single, trackers.Multi, trackers.Smoother, trackers.Deflicker])
def test_stream_equals_batch(spark, tmp_path, machine):
    rows = moving_object(40, {7, 8}) + [("w", f, 5.0 + f % 9, 1.0 * f, 3.0) for f in range(40)]
    for part in range(4):
        batch = spark.createDataFrame([r for r in rows if r[1] // 10 == part], DETECTED).coalesce(1)
        batch.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DETECTED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"tracks_{machine.__name__}"
    query = trackers.track_stream(stream, ["video"], machine).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    key = lambda r: (r.video, r.frame, r.track_id, round(r.x, 6), r.missed)
    batch = trackers.track(spark.createDataFrame(rows, DETECTED), ["video"], machine, chunk=15)
    assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, batch.collect()))


def test_streaming_aggregates(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i % 2}", 0.1 * (1 + i % 3), i) for i in range(20)], "run_id string, seconds double, tracks int")
    rows.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "frames"))
    query = trackers.running_metrics(stream).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    assert sorted(spark.table("metrics").collect()) == sorted(trackers.running_metrics(rows).collect())
    live = spark.createDataFrame([("s", i, float(i)) for i in range(30)], "source_id string, sec int, value double").select("source_id", F.timestamp_seconds("sec").alias("ts"), "value")
    assert {r.n for r in trackers.sliding_segments(live, "10 seconds", "5 seconds").collect()} == {5, 10}


def gain(sections, frequency):
    z = np.exp(-2j * np.pi * frequency)
    return np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in sections])


def test_butterworth_responses_are_those_of_the_design():
    warp = lambda f: np.tan(np.pi * f)
    for order in (1, 2, 3, 4, 5):
        for f in (0.01, 0.05, 0.08, 0.1, 0.12, 0.2, 0.4):
            low = 1 / np.sqrt(1 + (warp(f) / warp(0.1)) ** (2 * order))
            high = 1 / np.sqrt(1 + (warp(0.1) / warp(f)) ** (2 * order))
            band = 1 / np.sqrt(1 + ((warp(f) ** 2 - warp(0.08) * warp(0.12)) / (warp(f) * (warp(0.12) - warp(0.08)))) ** (2 * order))
            assert np.isclose(abs(gain(filtering.butterworth(order, None, 0.1), f)), low, rtol=1e-6)
            assert np.isclose(abs(gain(filtering.butterworth(order, 0.1, None), f)), high, rtol=1e-6)
            assert np.isclose(abs(gain(filtering.butterworth(order, 0.08, 0.12), f)), band, rtol=1e-6, atol=1e-9)
    assert abs(abs(gain(filtering.butterworth(2, 0.02, 0.4), np.arctan(np.sqrt(warp(0.02) * warp(0.4))) / np.pi)) - 1) < 1e-9


def test_sections_in_stretches_equal_one_sample_after_the_other():
    x = np.random.default_rng(5).normal(size=333)
    sections = filtering.butterworth(3, 0.05, 0.2)
    want = x
    for b, a in sections:
        level = b.sum() / a.sum()
        z, out = [want[0] * (level - b[0]), want[0] * (b[2] - a[2] * level)], []
        for v in want:
            out.append(b[0] * v + z[0])
            z = [b[1] * v - a[1] * out[-1] + z[1], b[2] * v - a[2] * out[-1]]
        want = np.array(out)
    assert np.allclose(filtering.run_sections(x, sections), want) and np.allclose(filtering.run_sections(x, sections, 7), want)


@pytest.mark.parametrize("size", [17, 1000])
def test_ends_are_reflected_or_fitted(spark, size):
    x = np.random.default_rng(6).normal(size=60).cumsum()
    df, keys = uniform(spark, x), ["source_id", "axis"]
    weights = filtering.low_pass(9, 0.1)
    found = ordered(filtering.reflected(df, keys, "idx", "value", weights, "s", size=size), "s")
    assert np.allclose(found, np.convolve(np.pad(x, 4, mode="reflect"), weights[::-1], "valid"))
    for derivative in (0, 1):
        found = ordered(filtering.fitted(df, keys, "idx", "value", 7, 3, "s", derivative, 0.5, size=size), "s")
        want = []
        for i in range(60):
            a = min(max(i - 3, 0), 53)
            fit = np.polynomial.Polynomial.fit(np.arange(7) * 0.5, x[a : a + 7], 3)
            want.append(fit.deriv(derivative)((i - a) * 0.5) if derivative else fit((i - a) * 0.5))
        assert np.allclose(found, want)
    assert np.isnan(ordered(filtering.fitted(uniform(spark, x[:5]), keys, "idx", "value", 7, 3, "s"), "s").astype(float)).all()


def test_percentiles_of_few_groups_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), None if i % 3 == 0 else float(i)) for g, n in ((1, 1), (2, 2), (3, 4000), (None, 900)) for i, v in enumerate(np.round(rng.exponential(size=n), 2 if g == 3 else 9))]
    df = spark.createDataFrame([*rows, (9, None, None)], "g int, a double, b double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in blocks.percentiles(df, ["g"], ["a", "b"], shares, parts=16).collect()}
    want = df.where("g is null or g <> 9").groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(q) for q in shares])).alias(c) for c in "ab"]).collect()
    assert len(got) == len(want) == 4
    for row in want:
        for c in "ab":
            assert got[row["g"]][c] == (None if row[c] is None else pytest.approx(row[c], rel=1e-12))


def test_series_without_local_maxima_give_their_top(spark):
    rows = [(1, "a", i, float(i), float(v)) for i, v in enumerate([1, 3, 3, 2])] + [(2, "a", i, float(i), float(v)) for i, v in enumerate([4, 4, 2])] + [(3, "a", 0, 0.0, None)]
    found = series.maxima_or_top(spark.createDataFrame(rows, "source_id int, axis string, idx int, t double, value double"))
    assert sorted((r.source_id, r.idx) for r in found.collect()) == [(1, 1), (2, 0)]


def test_free_decay_start_and_fit(spark):
    values = [0.1, 10.0, *[10 * 0.8**i for i in range(1, 15)]]
    rows = [(1, "a", i, float(i), v) for i, v in enumerate(values)] + [(2, "a", i, float(i), 5.0 * 0.01**i) for i in range(9)] + [(3, "a", i, float(i), 1.0) for i in range(5)]
    table = spark.createDataFrame(rows, "source_id int, axis string, idx int, t double, value double")
    starts = {r.source_id: r.start_t for r in series.free_decay_start(table, 0.3, 4.0).collect()}
    assert starts == {1: 7.0, 2: 1.0, 3: 0.0}
    assert {r.source_id: r.start_t for r in series.free_decay_start(table, 0.3, 12.0).collect()}[1] == 3.0
    fits = {r.source_id: r for r in series.free_decay_fit(table).collect()}
    assert fits[1].n == 11 and abs(fits[1].slope - np.log(0.8)) < 1e-9
    assert fits[2].n == 9 and abs(fits[2].slope - np.log(0.01)) < 1e-9 and fits[3].n is None and fits[3].tau is None


def test_standardised_metrics(spark):
    a, b = np.array([1.0, 4, 2, 8, 5]), np.array([2.0, 3, 1, 9, 9])
    table = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b)] + [(2, 1.0, float(y)) for y in b], "source_id int, a double, b double")
    got = {r.source_id: r for r in series.standardised_metrics(table, ["source_id"]).collect()}
    r = np.corrcoef(a, b)[0, 1]
    assert abs(got[1].pearson - r) < 1e-9 and abs(got[1].rmse_z - np.sqrt(2 - 2 * r)) < 1e-9 and got[2].pearson is None


def test_flag_best_marks_the_smallest_error(spark):
    from signalframe.operators import ranking

    rows = [(1, "x", 3.0), (1, "y", 3.0), (1, "z", None), (2, "x", 30.0), (3, "x", None)]
    got = ranking.flag_best(spark.createDataFrame(rows, "source_id int, axis string, error double"), "error", ["source_id"], "axis", 10.0)
    assert {(r.source_id, r.axis): (r.best, r.passed) for r in got.collect()} == {(1, "x"): (True, True), (1, "y"): (False, True), (1, "z"): (False, False), (2, "x"): (True, False), (3, "x"): (False, False)}
