import colorsys
import datetime
import math
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalframe.operators import aligning, colours, filtering, masks, ranking, series, spectral, stages, studies
from signalframe.plans import queries as base
from signalframe.sources import tables


def test_channels_of_colours(spark):
    rng = np.random.default_rng(3)
    rows = [*map(tuple, rng.integers(0, 256, (400, 3)).tolist()), (0, 0, 0), (255, 255, 255), (7, 7, 7), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(rows)], "i int, r int, g int, b int")
    found = {(r.i, r.mode): r.v for r in colours.by_mode(df).collect()}
    assert len(found) == 7 * len(rows)
    for i, (r, g, b) in enumerate(rows):
        h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert (found[i, "r"], found[i, "g"], found[i, "b"], found[i, "hsv_v"]) == (r, g, b, round(v * 255))
        assert abs(found[i, "hsv_s"] - 255 * s) <= 0.5 + 1e-9
        assert 0 <= found[i, "hsv_h"] < 180 and min(abs(found[i, "hsv_h"] - 180 * h), 180 - abs(found[i, "hsv_h"] - 180 * h)) <= 0.5 + 1e-9
        assert found[i, "gray"] == math.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    one = spark.createDataFrame([(10, 20, None)], "r int, g int, b int").coalesce(1)
    rgb = [F.col(c) for c in "rgb"]
    assert one.select(*[colours.channel(*rgb, m).alias(m) for m in colours.MODES]).first() == (None, 10, 20, None, None, None, None)
    assert df.where("i = 0").select(colours.channel(*rgb, "lab").alias("v")).first().v == found[0, "gray"]


def test_configurations_beside_the_first(spark):
    df = spark.createDataFrame([("gray", "num_unique_tracks", 5.0), ("r", "num_unique_tracks", 8.0), ("r", "other", 1.0), ("x", "num_unique_tracks", 3.0), ("gray", "mean_temporal_iou", None)], "configuration string, metric string, value double")
    rows = colours.configurations(df, ["gray", "g", "r"]).orderBy("place").collect()
    assert [(r.place, r.configuration, r.num_unique_tracks, r.num_unique_tracks_difference, r.mean_temporal_iou) for r in rows] == [(0, "gray", 5.0, 0.0, None), (1, "g", None, None, None), (2, "r", 8.0, 3.0, None)]
    assert [c for c in rows[0].asDict() if not c.endswith("_difference")] == ["place", "configuration", *colours.MEASURES]
    assert colours.configurations(df.limit(0), ["a"]).first().num_unique_tracks is None


@pytest.mark.parametrize("given, wanted", [((6, 9), (4, 6)), ((4, 6), (6, 9)), ((5, 5), (13, 13)), ((7, 3), (7, 3)), ((12, 8), (3, 2)), ((999, 1), (1000, 1))])
def test_masks_brought_to_a_size(spark, given, wanted):
    old = np.random.default_rng(1).integers(0, 2, given)
    cells = [("f", y, x, int(v)) for (y, x), v in np.ndenumerate(old)]
    fit, unlike = masks.fitted(spark.createDataFrame(cells, "frame string, y int, x int, value int"), spark.createDataFrame([("f", *given, *wanted)], "frame string, height int, width int, to_height int, to_width int"), ["frame"])
    got = {(r.y, r.x): r.on for r in fit.collect()}
    assert got == {(y, x): bool(old[y * given[0] // wanted[0], x * given[1] // wanted[1]]) for y in range(wanted[0]) for x in range(wanted[1])}
    assert unlike.count() == 0


def test_masks_of_another_aspect(spark):
    sizes = spark.createDataFrame([("a", 4, 4, 8, 9), ("b", 4, 4, None, 8), ("c", 2, 2, 4, 4), ("d", 0, 4, 4, 4), ("e", 1000, 1000, 1000, 1001)], "frame string, height int, width int, to_height int, to_width int")
    cells = spark.createDataFrame([(f, 0, 0, v) for f, v in (("a", 1), ("b", 1), ("c", None), ("d", 1), ("e", 1))], "frame string, y int, x int, value int")
    fit, unlike = masks.fitted(cells, sizes, ["frame"])
    assert sorted(r.frame for r in unlike.collect()) == ["a", "b", "d"]
    rows = sorted((r.frame, r.y, r.x, r.on) for r in fit.collect())
    assert rows == [("c", y, x, False) for y in (0, 1) for x in (0, 1)] + [("e", 0, 0, True), ("e", 0, 1, True)]  # 1001 columns from 1000: the first one twice


def plain_agreement(ta, va, tb, vb):
    start, end = max(ta[0], tb[0]), min(ta[-1], tb[-1])
    t = np.linspace(start, end, max(50, min(len(ta), len(tb))))
    sides = []
    for x in (np.interp(t, ta, va), np.interp(t, tb, vb)):
        scale = np.median(x[: max(3, round(0.05 * len(x)))])
        sides.append(x / (scale if scale > np.finfo(float).eps else np.abs(x).max()))
    e = sides[0] - sides[1]
    return len(t), np.corrcoef(*sides)[0, 1], np.sqrt(np.mean(e**2)), np.mean(np.abs(e)), np.corrcoef(e[:-1], e[1:])[0, 1]


@pytest.mark.parametrize("span, size", [(0.7, 7), (5.0, 1000), (1e6, 13)])
def test_envelopes_on_common_points(spark, span, size):
    rng = np.random.default_rng(5)
    series_of = {}
    for k, (n, m) in {"x": (400, 130), "y": (20, 30), "z": (3, 2)}.items():
        ta, tb = np.sort(rng.uniform(0, 20, n)), np.sort(rng.uniform(1, 22, m))
        series_of[k] = (ta, np.exp(-ta / 9) + rng.uniform(0, 0.05, n), tb, np.exp(-tb / 7) + rng.uniform(0, 0.05, m))
    table = lambda i: spark.createDataFrame([(k, float(t), float(v)) for k, s in series_of.items() for t, v in zip(s[i], s[i + 1], strict=True)] + [("w", 0.0 + 50 * i, 1.0), ("w", 1.0 + 50 * i, 2.0), (f"only{i}", 0.0, 1.0)], "s string, t double, value double")
    rows = {r.s: r for r in aligning.envelope_agreement(table(0), table(2), ["s"], span, size=size).collect()}
    assert set(rows) == {k for k, s in series_of.items() if max(s[0][0], s[2][0]) < min(s[0][-1], s[2][-1])}
    for k, r in rows.items():
        want = plain_agreement(*series_of[k])
        assert r.n == want[0] and [r.correlation, r.rmse, r.mae, r.residual_lag1] == pytest.approx(want[1:], abs=1e-9)


def test_flat_envelopes_have_no_correlation(spark):
    flat = spark.createDataFrame([("s", float(t), 2.0) for t in range(60)], "s string, t double, value double")
    row = aligning.envelope_agreement(flat, flat, ["s"], 10.0).first()
    assert (row.n, row.correlation, row.rmse, row.mae, row.residual_lag1) == (60, None, 0.0, 0.0, None)


def test_stages_by_name(spark):
    df = spark.createDataFrame([("s", "a", i, float(i), float(i * i)) for i in range(12)], "source_id string, axis string, idx int, t double, value double")
    got = stages.run(df, ["zscore", ("decimate", {"every": 4}), ("minmax", {"out": "m"})], every=2, alpha=0.1)
    want = series.minmax(series.decimated(series.zscore(df), 4), out="m")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="unknown stages fold, spin; there are relative_time"):
        stages.run(df, ["zscore", "fold", "spin"])
    with pytest.raises(TypeError, match="decimated needs every"):
        stages.run(df, ["decimate"])
    with pytest.raises(ValueError, match="missing columns: value"):
        stages.run(df, ["drop"], {"drop": lambda rows: rows.drop("value")})


def test_functions_by_name():
    one, two = SimpleNamespace(load=3, read=len), {"load": max}
    assert stages.find(["load", "read"], None, one, two) is len and stages.find(["load"], one, two) is max and stages.find(["x"], one, None) is None
    assert stages.call(lambda a, b=2, *rest: (a, b), a=1, c=3) == (1, 2) and stages.call(lambda **k: k, c=3) == {"c": 3}


def test_loaded_signals_have_one_form(spark):
    def rows(loaded, **options):
        df = tables.to_signal(spark, loaded, "dx", **options)
        assert df.columns == ["axis", "t", "value"] and dict(df.dtypes)["value"] == "double"
        return sorted((r.axis, r.t, r.value) for r in df.collect())

    want = [("dx", 0.5, 1.0), ("dx", 1.5, 2.0)]
    frame = spark.createDataFrame([("0.5", "no", "1"), ("1.5", "no", "2"), (None, "no", "3"), ("2.5", "no", "nan"), ("3", "no", "x")], "time_s string, note string, v string")
    assert rows(frame, time_column="time_s") == want
    assert rows(frame, time_column="time_s", relative=True) == [("dx", 0.0, 1.0), ("dx", 1.0, 2.0)]
    assert rows({"timestamps": [0.5, 1.5], "displacement": [1, 2], "unit": "px"}) == want and rows({"t": [0.5, 1.5], "dx": [1, 2]}) == want
    assert rows(([0.5, 1.5, None, 4.0], [1, 2, 3, math.inf])) == want and rows(SimpleNamespace(time=np.array([0.5, 1.5]), values=np.array([1, 2]))) == want
    assert rows(([], [])) == []
    stamps = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, s), 9, float(s)) for s in (5, 6)], "timestamp timestamp_ntz, n int, dx double")
    assert rows(stamps) == [("dx", 0.0, 9.0), ("dx", 1.0, 9.0)] and rows(stamps, value_column="dx") == [("dx", 0.0, 5.0), ("dx", 1.0, 6.0)]
    for wrong in (3, {"t": [1]}, [1]):
        with pytest.raises(TypeError, match="no times and values"):
            rows(wrong)
    with pytest.raises(ValueError, match="no column of numbers"):
        rows(frame.select("time_s", "note"), time_column="time_s")
    with pytest.raises(ValueError):
        rows(([1.0], [1.0, 2.0]))


@pytest.mark.parametrize("width", [0.5, 30.0, 1e4])
def test_regions_meet_vectors_by_strips(spark, width):
    rng = np.random.default_rng(2)
    vectors = [(int(f), float(x), float(a), float(b)) for f, x, a, b in zip(rng.integers(0, 3, 300), rng.uniform(-50, 150, 300), rng.normal(size=300), rng.normal(size=300), strict=True)] + [(9, 20.0, 3.0, 4.0), (9, None, 1.0, 1.0)]
    regions = [("a", -10.0, 20.0), ("b", 20.0, 21.0), ("c", 0.0, 150.0), ("empty", 5.0, 5.0)]
    df = studies.by_region(spark.createDataFrame(vectors, "frame int, x double, dx double, dy double"), spark.createDataFrame(regions, "roi string, x_from double, x_to double"), width)
    got = {(r.frame, r.roi): (r.n, r.max_m) for r in df.collect()}
    want = {}
    for f, x, a, b in vectors:
        for roi, low, top in regions:
            if x is not None and low <= x < top:
                n, m = want.get((f, roi), (0, 0.0))
                want[f, roi] = (n + 1, max(m, math.hypot(a, b)))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["spectrum_symmetric_detrended", "spectrum_dominant_unwindowed", "series_downsampled_dominant", "series_antialiased", "archive_measurements", "archive_conclusion"])
def test_resampled_series_are_not_broadcast(spark, name):
    """The plan's sizes come from the compressed table, of which a resampled series or its spectra are many times."""
    assert broadcasts(base.queries()[name](spark, "/root/testdata/sf0.001")) == 0


def test_trend_of_a_grid_in_one_join(spark):
    rows = [("a", "x", 100 + k, v) for k, v in enumerate((1.0, 4.0, 2.0, 9.0))] + [("b", "x", 7, 3.0)]
    found = spectral.prepared(spark.createDataFrame(rows, "source_id string, axis string, k long, value double"), detrend="linear")
    got = {(r.source_id, r.i): r.x for r in found.collect()}
    y = np.array([1.0, 4.0, 2.0, 9.0])
    s, c = np.polyfit(np.arange(4), y, 1)
    assert np.allclose([got["a", i] for i in range(4)], y - s * np.arange(4) - c)
    assert got["b", 0] == 0


def test_spectra_of_single_samples(spark):
    """Their Hann window is 0 throughout."""
    rows = [("a", "x", 3, 5.0)] + [("b", "x", k, v) for k, v in enumerate((1.0, 4.0, 2.0, 9.0))]
    grid = spark.createDataFrame(rows, "source_id string, axis string, k long, value double")
    for detrend, kind in (("mean", "periodic"), ("linear", "symmetric")):
        found = {(r.source_id, r.bin): r.amplitude for r in spectral.spectrum(spectral.prepared(grid, detrend=detrend), 1.0, 0.0, 0.5, kind).collect()}
        assert sorted(found) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]
        assert math.isnan(found["a", 0]) and found["b", 1] > 0


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables, each a DuckDB SELECT."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found, want = base.queries()[name](spark, str(folder)), con.execute(base.oracle_sql()[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, found.select(*names).collect())), sorted(want.fetchall()), names


def test_objects_of_an_empty_frame(spark, tmp_path):
    orders = "select 7::BIGINT as o_orderkey, 1::BIGINT as o_custkey, '5-LOW' as o_orderpriority, 100.0::DOUBLE as o_totalprice"
    found, want, _ = against_sql(spark, tmp_path, "frame_objects", customer="select unnest([1, 2])::BIGINT as c_custkey", orders=orders)
    assert found == want == [(1, 1, "7/5-LOW"), (2, 0, "")]


def test_two_samples_have_no_score(spark, tmp_path):
    """A line through two samples leaves nothing, so no rounding may be standardised."""
    events = "select i as event_id, TIMESTAMP '2024-01-01' + to_microseconds((i * 7919 % 1000 * 2592000017) // 1) as ts, i // 2 as user_id, 'view' as event_type, i * 37 % 1009 / 7.0::DOUBLE as value from range(400) r(i)"
    found, want, names = against_sql(spark, tmp_path, "series_staged", events=events)
    assert found == want and len(found) == 200
    assert {r[names.index(c)] for r in found for c in ("value", "z", "unit")} == {0.0}


def test_dominant_frequency_on_a_rounding_step(spark, tmp_path):
    """Bin 3 of 80 samples each 6 hours is 0.00625."""
    events = "select k as event_id, TIMESTAMP '2024-01-01' + to_hours(6 * k) as ts, 1::BIGINT as user_id, 'view' as event_type, 10 * sin(2 * pi() * 3 * k / 80) as value from range(81) r(k)"
    found, want, names = against_sql(spark, tmp_path, "spectrum_profile", events=events)
    assert found[0][names.index("dominant")] == want[0][names.index("dominant")] == 0.0063


def test_profiles_of_three_samples_and_more(spark, tmp_path):
    """Users 0 .. 3 have 1 .. 4 samples on the grid of 6 hours; the SQL has no spectrum of fewer than three."""
    events = "select 10 * u + k as event_id, TIMESTAMP '2024-01-01' + to_hours(6 * (u + 1) * k) as ts, u as user_id, 'view' as event_type, 1.0::DOUBLE + k * (u + 3) as value from range(4) r(u), range(2) s(k)"
    found, want, names = against_sql(spark, tmp_path, "spectrum_profile", events=events)
    assert found == want and [r[names.index("source_id")] for r in found] == [2, 3]


@pytest.mark.parametrize("held", [7, 100_000])
def test_spectrum_of_long_and_short_series_in_parts(spark, held):
    """A direct sum over samples and bins of 60 000 samples would be 1.8e9 terms."""
    rng = np.random.default_rng(5)
    data = {("a", n): rng.normal(size=n) for n in ((9, 9, 16, 31) if held < 10 else (60_000, 12, 3))}
    rows = [(key, n, k, float(v)) for (key, n), x in data.items() for k, v in enumerate(x)]
    grid = spark.createDataFrame(rows, "source_id string, axis int, k long, value double").repartition(3)
    found = {}
    for r in spectral.spectrum(spectral.prepared(grid), 1.0, 0.0, 0.5, held=held).collect():
        found.setdefault((r.source_id, r.axis), {})[r.bin] = r.amplitude
    for (key, n), x in data.items():
        w = spectral.hann("periodic", np.arange(n), n)
        want = abs(np.fft.rfft((x - x.mean()) * w)) / w.sum() * 2
        want[[0] + ([n // 2] if n % 2 == 0 else [])] /= 2
        assert np.allclose([found[key, n][b] for b in range(n // 2 + 1)], want, atol=1e-12)


def test_harmonics_make_their_spectra_once(spark):
    plan = base.queries()["harmonics_compared"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_anti_aliasing_goes_through_python_once(spark):
    """Neither a Python group a series and factor nor a second pass over the samples."""
    plan = base.queries()["series_antialiased"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


@pytest.mark.parametrize("held", [1, 40, 1_000_000])
def test_anti_aliased_series_of_all_lengths(spark, held):
    rng = np.random.default_rng(8)
    data = {(f"s{i}", axis): rng.normal(size=n) + 5 for i, n in enumerate((1, 2, 3, 4, 5, 9, 12, 12, 13, 30_000)) for axis in "ab"}
    rows = [(*key, k - 7, float(v)) for key, x in data.items() for k, v in enumerate(x)]
    grid = spark.createDataFrame(rows, "source_id string, axis string, k long, value double").repartition(5, "k")
    found = {(r.source_id, r.axis, r.factor): r for r in studies.anti_aliased(grid, [1, 2, 4], 6.0, 10.0, taps=11, held=held).collect()}
    want = {}
    for key, x in data.items():
        for f in (1, 2, 4):
            pad = min(len(x) - 1, 5)
            whole = np.pad(np.pad(x, pad, mode="reflect"), 5 - pad)
            y = (np.convolve(whole, filtering.low_pass(11, 0.9 / (2 * f)), "valid") if f > 1 else x)[::f]
            if len(y) >= 3:
                w = spectral.hann("periodic", np.arange(len(y)), len(y))
                a = abs(np.fft.rfft((y - y.mean()) * w))[1:] * np.where(2 * np.arange(1, len(y) // 2 + 1) == len(y), 0.5, 1)
                want[*key, f] = (len(y), (1 + a.argmax()) / len(y) / (6.0 * f), np.subtract(*np.quantile(y, [0.95, 0.05])) / 2)
    assert found.keys() == want.keys()
    for key, (n, dominant, amplitude) in want.items():
        r, first = found[key], want[*key[:2], 1]
        assert r.n == n and [r.dominant, r.amplitude, r.rate] == pytest.approx([dominant, amplitude, 1 / (6 * key[2])], rel=1e-9)
        assert [r.frequency_error, r.amplitude_error] == pytest.approx([100 * abs(x - y) / y for x, y in zip((dominant, amplitude), first[1:], strict=True)], rel=1e-6, abs=1e-9)


def test_partners_by_blocks_and_tiles(spark):
    """The pairs stay in their tasks: one shuffle of each side and one of the best."""
    rng = np.random.default_rng(2)
    columns = ("frequency", "centroid", "bandwidth", "duration", "quality")
    data = [(f"{i}/x", *[float(v) for v in rng.integers(1, 5, 5)]) for i in range(60)] + [("n/x", 1.0, None, 2.0, 3.0, 4.0)]
    rows = spark.createDataFrame(data, "id string, " + ", ".join(f"{c} double" for c in columns))
    left, right = (rows.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("left", "right"))
    left = left.where("left_id in ('0/x', '7/x', '31/x', 'n/x')")
    pairs = left.crossJoin(right).where("left_id <> right_id").withColumn("score", ranking.pair_similarity())
    order = Window.partitionBy("left_id").orderBy(F.desc(F.round("score", 9)), "right_id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    found = ranking.ranked_partners(left, right, 3, block=2, tiles=3)
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted((r.left_id, r.rank, r.right_id, r.score and round(r.score, 9)) for r in df.collect())
    assert plain(found) == plain(want) and len(plain(found)) == 12
