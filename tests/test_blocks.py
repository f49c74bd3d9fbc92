"""Long series in blocks, as-of alignment, flicker, Welch, decimation, archive search and extraction success against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalframe.operators import aligning, blocks, extraction, filtering, flicker, matching, series, spectral, studies
from signalframe.streaming import trackers

SERIES = "source_id string, axis string, idx long, t double, value double"


def table(spark, n=60, seed=1, gaps=False):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0.5, 1.0, 40.0] if gaps else [0.5, 1.0], n))
    rows = [(s, "a", i, float(t[i] + o), float(v)) for s, o in (("s", 0.0), ("u", 7.25)) for i, v in enumerate(rng.normal(size=n))]
    return rows, spark.createDataFrame(rows, SERIES)


def column(df, name, source="s", by="idx"):
    rows = sorted((r for r in df.collect() if r.source_id == source), key=lambda r: r[by])
    return np.array([np.nan if r[name] is None else r[name] for r in rows], float)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_do_not_depend_on_blocks(spark, size):
    rows, df = table(spark)
    x = np.array([r[4] for r in rows if r[0] == "s"])
    t = np.array([r[3] for r in rows if r[0] == "s"])
    ema, held = [x[0]], [np.nan]
    for i, v in enumerate(x):
        ema.append(0.7 * ema[-1] + 0.3 * v if i else v)
        held.append(v if v > 1 else held[-1])
    assert np.allclose(column(series.ema(df, 0.3, size=size), "ema"), ema[1:], rtol=1e-12)
    assert np.array_equal(column(series.hold_last(df, series.KEYS, "idx", F.col("value") > 1, ["value"], size), "held_value"), held[1:], equal_nan=True)
    assert np.allclose(column(series.gradient(df, size=size), "slope"), np.gradient(x, t), rtol=1e-9)
    assert np.allclose(column(series.differences(df, size=size), "dv")[1:], np.diff(x))
    w = series.gaussian(1.0, 3.0)
    assert np.allclose(column(series.weighted_window(df, w, "y", size=size), "y"), np.convolve(np.pad(x, 3, mode="edge"), w, "valid"))
    peaks = [i for i in range(1, 59) if x[i] > x[i - 1] and x[i] >= x[i + 1]]
    assert column(series.local_maxima(df, size=size), "idx").tolist() == peaks
    k = np.arange(np.ceil(t[0] / 0.3), np.ceil(t[-1] / 0.3))
    assert np.allclose(column(series.resampled(df, 0.3, size=size), "value", by="k"), np.interp(k * 0.3, t, x))
    whole = filtering.prominent_peaks(df, series.KEYS, "idx", "value", 0.5, 20, 4).collect()
    assert sorted(filtering.prominent_peaks(df, series.KEYS, "idx", "value", 0.5, 20, 4, size).collect()) == sorted(whole) and whole
    assert column(blocks.numbered(df.drop("idx"), series.KEYS, "t", "idx", size / 3), "value").tolist() == x.tolist()


@pytest.mark.parametrize("size", [1, 4, 100_000])
@pytest.mark.parametrize("alpha", [0.3, 1.0])
def test_means_of_many_short_series(spark, size, alpha):
    inf, nan = float("inf"), float("nan")
    series_of = {(f"s{n}", a): [float((n * k) % 5) for k in range(1 + n % 9)] for n in range(40) for a in "ab"}
    if alpha < 1:
        series_of |= {("nan", None): [1.0, 2.0, nan, 4.0, 5.0, 6.0, 7.0], (None, "a"): [1.0, inf, 3.0, 4.0, 5.0, 6.0], (None, "b"): [2.0, 3.0]}
    df = spark.createDataFrame([(*k, i, 0.0, v) for k, x in series_of.items() for i, v in enumerate(x)], SERIES)
    out = series.ema(df, alpha, size=size)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan  # Python groups for the ends of full blocks alone
    found = {(r.source_id, r.axis, r.idx): r.ema for r in out.collect()}
    want = {}
    for k, x in series_of.items():
        y = x[0]
        for i, v in enumerate(x):
            y = (1 - alpha) * y + alpha * v
            want[*k, i] = y
    assert found.keys() == want.keys()
    assert np.allclose([found[k] for k in want], list(want.values()), rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("span", [0.7, 30.0, 1e6])
def test_as_of_values_are_linear_between_neighbours(spark, span):
    rows, df = table(spark, gaps=True)
    t, x = (np.array([r[i] for r in rows if r[0] == "s"]) for i in (3, 4))
    wanted = [float(v) for v in np.linspace(t[0] - 5, t[-1] + 5, 97)] + [float(t[0]), float(t[17]), float(t[-1]), None]
    targets = spark.createDataFrame([("s", "a", i, v) for i, v in enumerate(wanted)] + [("none", "a", 999, 5.0)], "source_id string, axis string, n int, t double")
    found = aligning.as_of(targets, df, series.KEYS, span)
    assert found.columns == ["source_id", "axis", "t", "n", "value"] and found.count() == len(wanted) + 1
    got = column(found, "value", by="n")
    inside = np.array([v is not None and t[0] <= v <= t[-1] for v in wanted])
    assert np.array_equal(np.isnan(got), ~inside)
    assert np.allclose(got[inside], np.interp([v for v, ok in zip(wanted, inside, strict=True) if ok], t, x))
    assert [r.value for r in found.where("n = 999").collect()] == [None]


@pytest.mark.parametrize("mode, manual", [("manual", 3.25), ("none", None), ("timestamp", None), ("correlation", None)])
def test_synchronised_series(spark, mode, manual):
    t = np.arange(0, 200, 0.5)
    signal = lambda t: np.sin(0.3 * t) + 0.3 * np.sin(1.1 * t)
    reference = spark.createDataFrame([("s", float(v), float(signal(v))) for v in t], "source_id string, t double, value double")
    moving = spark.createDataFrame([("s", float(v) + 1.0, float(signal(v + 1.0 - 2.0))) for v in t], "source_id string, t double, value double")
    k = range(2, 390)
    pairs = spark.createDataFrame([("s", i, float(signal(i * 0.5)), float(signal(i * 0.5 - 2.0))) for i in k], "source_id string, k long, a double, b double")
    lags = aligning.lag_seconds(pairs, ["source_id"], 0.5, mode, 10, manual)
    lag = {"manual": 3.25, "correlation": 2.0}.get(mode, 0.0)
    assert [r.lag_s for r in lags.collect()] == [lag]
    found = sorted(aligning.synchronised(reference, moving, lags, ["source_id"], 4.0, 9.0).collect(), key=lambda r: r.k)
    start, end = max(0.0, 1.0 - lag), min(199.5, 200.5 - lag)
    grid = start + np.arange(int((end - start) * 4) + 1) / 4
    assert len(found) == len(grid) and np.allclose([r.a for r in found], np.interp(grid, t, signal(t)))
    assert np.allclose([r.b for r in found], np.interp(grid, t + 1.0 - lag, signal(t - 1.0)))
    if mode == "correlation":
        assert max(abs(r.a - r.b) for r in found) < 0.05
    with pytest.raises(ValueError):
        aligning.lag_seconds(pairs, ["source_id"], 0.5, "guess")


def plain_gains(x, n, f, second, alpha, least):
    """The recurrence value by value with a real transform of each history."""
    out, history, target = [], [], x[0]
    for i, v in enumerate(x):
        history = [*history, v][-n:]
        part = None
        if i and len(history) >= least:
            spectrum = np.fft.rfft(np.array(history) - np.mean(history))
            freqs, keep = np.arange(len(spectrum)) / len(history), np.zeros_like(spectrum)
            for g, w in [(f, 1.0)] + [(2 * f, 0.5)] * second:
                mid = np.argmin(np.round(np.abs(freqs - g), 12))
                for k, u in ((mid, w), (mid - 1, w / 2), (mid + 1, w / 2)):
                    if mid > 0 and k < len(freqs):
                        keep[k] = u * spectrum[k]
            part = np.fft.irfft(keep, len(history))[-1]
            target = alpha * (x[0] - part) + (1 - alpha) * target
        out.append((part, 1.0 if not i or v < 1e-6 else (target if len(history) >= least else x[0]) / v))
    return out


@pytest.mark.parametrize("second, size", [(False, 50), (True, 37), (True, 10_000)])
def test_flicker_in_blocks_equals_the_stream_and_a_plain_version(spark, second, size):
    i = np.arange(400)
    x = np.maximum(0, 100 + 10 * np.cos(2 * np.pi * 0.2 * i) + 3 * np.cos(2 * np.pi * 0.4 * i) + np.random.default_rng(3).normal(size=400))
    x[50] = 0.0
    want = plain_gains(x, 64, 0.2, second, 0.2, 16)
    df = spark.createDataFrame([("s", "a", int(k), 0.0, float(v)) for k, v in zip(i, x, strict=True)], SERIES)
    found = sorted(flicker.flicker_gain(df, series.KEYS, "idx", "value", 0.2, 64, second, 0.2, 16, size).collect(), key=lambda r: r.idx)
    machine = trackers.Deflicker(64, 0.2, 0.2, 16, second)
    stream = trackers.advance(machine, pd.DataFrame({"frame": i, "x": x, "y": 0.0, "area": 0.0}))
    for row, live, gain, (part, wanted) in zip(found, stream["y"].tolist(), stream["x"].tolist(), want, strict=True):
        assert row.gain == pytest.approx(wanted, rel=1e-9) and gain == pytest.approx(wanted, rel=1e-9)
        assert (row.flicker is None) == (part is None)
        if part is not None:
            assert row.flicker == pytest.approx(part, abs=1e-9) and live == pytest.approx(part, abs=1e-9)


@pytest.mark.parametrize("length, n", [(16, 400), (2048, 20_000)])
def test_welch_matches_numpy(spark, length, n):
    rng = np.random.default_rng(5)
    a = rng.normal(size=n)
    b = np.roll(a, 3) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"source_id": "s", "k": np.arange(n) + 11, "a": a, "b": b}))
    df = df.where(f"k <> {n - 100}")  # a hole: segments over it fall away
    found = sorted(spectral.coherence(df, length, 0.5, ["source_id"]).collect(), key=lambda r: r.bin)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    starts = [s for s in range(0, n - length + 1, length // 2) if not s <= n - 111 < s + length]
    cut = [np.fft.rfft((x[s : s + length] - x[s : s + length].mean()) * window)[1:] for x in (a, b) for s in starts]
    A, B = np.array(cut[: len(starts)]), np.array(cut[len(starts) :])
    psd = (abs(A) ** 2).mean(0) * 0.5 / (window**2).sum() * np.append(np.full(length // 2 - 1, 2.0), 1.0)
    want = abs((A * B.conj()).mean(0)) ** 2 / ((abs(A) ** 2).mean(0) * (abs(B) ** 2).mean(0))
    assert {r.segments for r in found} == {len(starts)} and [r.bin for r in found] == list(range(1, length // 2 + 1))
    assert np.allclose([r.psd_a for r in found], psd, rtol=1e-9) and np.allclose([r.coherence for r in found], want, rtol=1e-9)


def test_flat_series_have_no_coherence(spark):
    df = spark.createDataFrame([("s", k, 0.1, float(k % 5)) for k in range(64)], "source_id string, k long, a double, b double")
    rows = spectral.coherence(df, 16, 1.0, ["source_id"]).collect()
    assert all(r.psd_a == 0 and r.coherence is None for r in rows) and any(r.psd_b > 0 for r in rows)


@pytest.mark.parametrize("n, size", [(500, 23), (500, 10_000), (30, 7)])
def test_decimation_equals_filter_then_thin(spark, n, size):
    x = np.random.default_rng(6).normal(size=n)
    df = spark.createDataFrame([("s", "a", i, 0.0, float(v)) for i, v in enumerate(x)], SERIES)
    h = filtering.low_pass(101, 0.9 / 8)
    pad = min(n - 1, 300)
    want = np.convolve(np.pad(np.pad(x, pad, mode="reflect"), 50), h, "valid")[pad:-pad][::4]
    assert np.abs(column(filtering.decimated_low_pass(df, series.KEYS, "idx", "value", h, 4, "y", size), "y") - want).max() < 1e-12


def test_anti_aliased_factors(spark):
    i = np.arange(800)
    x = np.sin(2 * np.pi * 0.02 * i) + 0.8 * np.sin(2 * np.pi * 0.27 * i)  # the second would fold into the band
    grid = spark.createDataFrame([("s", "a", int(k) + 5, float(v)) for k, v in zip(i, x, strict=True)], "source_id string, axis string, k long, value double")
    rows = {r.factor: r for r in studies.anti_aliased(grid, [1, 4, 40], 0.5, 10.0).collect()}
    assert rows[4].dominant == pytest.approx(0.04, rel=0.03) and rows[4].frequency_ok and rows[4].rate == 0.5 and rows[1].frequency_error == 0
    assert not rows[40].below_nyquist and not rows[40].frequency_ok and rows[40].n == 20


def test_band_limited_metrics(spark):
    i = np.arange(3000)
    rng = np.random.default_rng(7)
    a = np.sin(2 * np.pi * 0.05 * i) + rng.normal(size=3000) * 0.1 + 5
    b = -2 * np.sin(2 * np.pi * 0.05 * (i - 4)) + 0.01 * i
    df = spark.createDataFrame(pd.DataFrame({"p": "x", "k": i + 40, "a": a, "b": b}))
    row = series.band_limited_metrics(df, ["p"], 4, 0.03, 0.08, 8, 200).first()
    sections = filtering.butterworth(4, 0.03, 0.08)
    fa, fb = (filtering.zero_phase(v, sections)[200:-200] for v in (a, b))
    assert row.lag == 4 and row.n == 2600 - 4
    fa, fb = fa[:-4], fb[4:]
    za, zb = ((v - v.mean()) / v.std() for v in (fa, fb))
    assert row.pearson == pytest.approx((za * zb).mean(), abs=1e-6) and row.abs_pearson > 0.99
    assert row.rms_a == pytest.approx(np.sqrt((fa**2).mean()), rel=1e-6) and row.rms_b == pytest.approx(np.sqrt((fb**2).mean()), rel=1e-6)
    assert row.rmse_z == pytest.approx(np.sqrt(((zb - za) ** 2).mean()), rel=1e-6) and row.mae_z == pytest.approx(abs(zb - za).mean(), rel=1e-6)


# --- archive search ---------------------------------------------------------------------------------------------------


def test_measurements_windows_and_conclusion(spark):
    peaks = spark.createDataFrame([("m", "x", b, b / 100, float(a)) for b, a in enumerate([0, 1, 5, 1, 3, 1])] + [("m", "y", b, b / 100, float(6 - b)) for b in range(6)] + [("n", "x", b, b / 100, 1.0) for b in range(3)], "source_id string, axis string, bin int, frequency double, amplitude double")
    lists = matching.peak_lists(peaks, 0.04, 5, 0.005, 0.05, series.KEYS)
    found = {(r.source_id, r.axis): [(p["rank"], p.frequency) for p in r.peaks] for r in lists.collect()}
    assert found == {("m", "x"): [(1, 0.02), (2, 0.04)], ("m", "y"): [(1, 0.01)], ("n", "x"): [(1, 0.01)]}
    signals = spark.createDataFrame([(s, a, i, float(t + i), float(i)) for s, a, t in (("m", "x", 100), ("m", "y", 101), ("m", "z", 100), ("n", "x", 10)) for i in range(10)], SERIES)
    rows = matching.measurements(signals, lists, (0.0, 5.0))
    m = rows.where("source_id = 'm'").first()
    assert (m.rows, m.start, m.end, m.overlap, m.gap, m.best_axis, m.any_axis, m.any_rank) == (30, 100.0, 110.0, 0.0, 95.0, "x", "x", 2)
    assert [(a.axis, a.status) for a in m.axes] == [("x", "ok"), ("y", "ok"), ("z", "no_peaks")] and m.best_error == pytest.approx(50) and m.any_error == pytest.approx(0)
    counts = {r.margin: (r.temporal, r.simultaneous, r.best_gap) for r in matching.window_counts(rows, [1.0, 6.0, 100.0], 5.0).collect()}
    assert counts == {1.0: (0, 0, None), 6.0: (1, 0, 5.0), 100.0: (2, 1, 5.0)}
    one = matching.search_summary(rows, 1.0, [1.0, 6.0, 100.0, 200.0], 5.0).first()
    assert (one.conclusion, one.earliest_margin, one.earliest_count, one.widest_margin, one.widest_count) == ("exploratory", 100.0, 1, 200.0, 1)
    assert matching.search_summary(rows, 100.0, [1.0], 5.0).first().conclusion == "matched"
    empty = matching.search_summary(rows.limit(0), 1.0, [1.0], 5.0).first()
    assert (empty.conclusion, empty.measurements, empty.earliest_count, empty.earliest_margin) == ("none", 0, 0, None)


# --- extraction success -------------------------------------------------------------------------------------------------


def test_success_follows_the_first_column_that_is_there(spark):
    rows = [(1, "1", "0", "1", "lost", "ok", "0.5", "no"), (1, "2", "2", "0", "ok", "lost", None, "no"), (1, "x", "1", "1", "ok", "ok", "0.9", "no"), (1, "2", "ok", "1", "ok", "ok", "nan", "no"), (2, "7", "Valid ", "1", "ok", "1", "0.1", "no")]
    df = spark.createDataFrame(rows, "video_id int, frame string, detection_success string, segmentation_valid string, detected string, status string, score string, other string")
    sources = spark.createDataFrame([(1, 2), (2, 4), (3, 0)], "video_id int, source_frames long")

    def found(drop):
        out = extraction.reported_success(df.drop(*drop), sources, extraction.DETECTOR_SUCCESS, "score")
        return {r.video_id: (r.observed, r.successful, r.missing, r.failed, r.full_length, r.success_column, r.rule) for r in out.collect()}

    columns = list(extraction.DETECTOR_SUCCESS)
    assert found([]) == {1: (2, 1, 0, 1, True, "detection_success", "column"), 2: (1, 1, 3, 0, False, "detection_success", "column"), 3: (0, 0, 0, 0, False, "detection_success", "column")}
    assert found(columns[:1])[1][1:] == (2, 0, 0, True, "segmentation_valid", "column")
    assert found(columns[:2])[1][1:] == (1, 0, 1, True, "detected", "column")
    assert found(columns[:3])[1][1:] == (2, 0, 0, True, "status", "column")
    assert found(columns)[1][1:] == (1, 0, 1, True, "", "score")
    assert found([*columns, "score"])[1][1:] == (2, 0, 0, True, "", "represented")
    flags = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, None)], "video_id int, frame int, inner_pipe_detected boolean")
    assert extraction.reported_success(flags, sources, extraction.CLASSICAL_SUCCESS).where("video_id = 1").first().successful == 1
