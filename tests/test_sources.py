import json

import pytest
from pyspark.sql import functions as F

from signalframe.functions import scalars
from signalframe.operators import extraction
from signalframe.sources import tables


def test_delimiters_and_formats(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.txt", ";"), ("c.tsv", "\t")):
        (tmp_path / name).write_text(sep.join(["time_seconds", "v"]) + "\n" + sep.join(["0.5", "x"]) + "\n")
        assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / name)).collect()] == [("0.5", "x")]
    spark.range(3).write.parquet(str(tmp_path / "d.parquet"))
    assert tables.read_table(spark, str(tmp_path / "d.parquet")).count() == 3


def test_track_reader_is_strict(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("time_seconds,y,inner_pipe_track_valid\n0,1,1\n1,oops,1\n2,3,0\n3,nan,1\n4,5,1\n")
    assert [(r.t, r.value) for r in tables.read_track(spark, str(path), "y").orderBy("t").collect()] == [(0.0, 1.0), (4.0, 5.0)]
    assert tables.read_track(spark, str(path), "y", valid_only=False).count() == 3
    path.write_text("time_seconds,y\n0,1\n0,2\n")
    with pytest.raises(ValueError, match="repeated"):
        tables.read_track(spark, str(path), "y")
    with pytest.raises(ValueError, match="missing"):
        tables.read_track(spark, str(path), "z")


def test_archive_scan(spark, tmp_path):
    for day, n in (("2022-04-16", 3), ("2022-04-17", 2)):
        folder = tmp_path / day / "m1"
        folder.mkdir(parents=True)
        lines = ["day time linx liny linz rotx roty rotz"] + [f"{day} 19:46:3{i}.250000  1 2   3 4 5 {i}" for i in range(n)] + [f"{day} broken"]
        (folder / "data.csv").write_text("\n".join(lines) + "\n\n")
        (folder / "other.csv").write_text("x\n")
    rows = tables.read_archive(spark, str(tmp_path))
    good, failed = tables.split_failures(rows, {"time": F.col("at").isNotNull(), "axis": F.col("linx").isNotNull()})
    assert good.count() == 5 and [r.error for r in failed.collect()] == ["time, axis"] * 2
    assert tables.read_archive(spark, str(tmp_path), day="2022-04-17").where("at is not null").count() == 2
    signals = tables.long_signals(good)
    assert signals.count() == 30 and {r.t for r in signals.collect()} == {0.0, 1.0, 2.0}


def test_classification_and_aliases(spark):
    rows = spark.createDataFrame([(" ", "b", 3), ("a", "c", None)], "IMU_path string, imu_csv string, rank int")
    found = tables.first_known(rows, {"imu": ["imu_path", "imu_csv"], "rank": ["rank"], "id": ["id"]})
    assert [tuple(r) for r in found.collect()] == [("b", "3", None), ("a", None, None)]


def test_time_inference(spark):
    row = spark.createDataFrame([("2022-04-16", "00:00:01.5", "12", 400)], "day string, time string, stamp string, frame int")
    seconds = lambda df, **k: df.select(tables.infer_time(df, **k).alias("t")).first().t
    assert seconds(row) == pytest.approx(1650067201.5)
    assert seconds(row.select("frame"), fps=200.0) == 2.0
    assert seconds(row.select(F.col("stamp").alias("time"))) == 12.0
    with pytest.raises(ValueError, match="no time"):
        tables.infer_time(row.select("stamp"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2.0), (2, float("inf"), 3.0)], "id int, a double, b double")
    tables.write_json(df, str(tmp_path / "j"))
    text = [json.loads(line) for p in (tmp_path / "j").glob("part-*") for line in p.read_text().splitlines()]
    assert sorted(text, key=lambda r: r["id"]) == [{"id": 1, "b": 2.0}, {"id": 2, "b": 3.0}]
    tables.write_metrics(df.select("id", "b"), ["id"], ["b"], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    tables.write_stages({"raw": df, "clean": df.limit(1)}, str(tmp_path / "s"))
    assert {r.stage: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("stage").count().collect()} == {"raw": 2, "clean": 1}
    results = spark.createDataFrame([(1,), (2,)], "id int")
    assert tables.append_new(results, str(tmp_path / "r"), "id") == 2
    assert tables.append_new(results.union(spark.createDataFrame([(3,)], "id int")), str(tmp_path / "r"), "id") == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [1, 2, 3]
    (tmp_path / "masks").mkdir()
    (tmp_path / "masks" / "m.PNG").write_bytes(b"123")
    assert [r.length for r in tables.inventory(spark, str(tmp_path / "masks"), [".png"]).collect()] == [3]


def test_flattening(spark):
    df = spark.sql("select named_struct('b', named_struct('c', 1, 'd', 2)) as a, 5 as e")
    assert tables.flattened(df).columns == ["a.b.c", "a.b.d", "e"]


def test_scalars(spark):
    row = spark.sql("select 'OK' as a, '0' as b, 'no' as c, cast(null as string) as d, 3.0D as p, cast(null as double) as q")
    values = row.select(
        *[extraction.succeeded(F.col(c)).alias(c) for c in "abcd"], scalars.weighted({"p": 2.0, "q": 5.0}).alias("w"), scalars.weighted({"q": 5.0}).alias("n"),
        scalars.percent(F.lit(1), F.lit(0)).alias("z"), scalars.relative_error(F.lit(1.1), F.lit(1e-12)).alias("e"), scalars.frame_name(F.lit(7)).alias("name"), scalars.frame_number(F.lit("frame_000007.png")).alias("number"),
    ).first()
    assert tuple(values) == (True, False, False, False, 3.0, None, None, None, "frame_000007", 7)


def test_result_files_follow_the_fixed_names(spark):
    names = [
        "/o/GX010129/GX010129_lucas_kanade.csv", "/o/gx010129_lucas_kanade_timeseries.csv", "/o/GX1_farneback_dense.csv", "/o/GX1_detectron2_results.csv", "/o/opencv/GX010130_frames.csv",
        "/o/opencv/no_id.csv", "/o/GX2_results.csv", "/o/extraction_success_all_methods/GX3_lucas_kanade.csv", "/o/GX4_benchmark_lucas_kanade.csv", "/o/GX1_farneback_dense.csv", "/o/GX5_lucas_kanade.txt",
    ]
    found = sorted(tuple(r) for r in tables.result_files(spark.createDataFrame([(n,) for n in names], "path string")).collect())
    assert found == [
        ("/o/GX010129/GX010129_lucas_kanade.csv", "lucas_kanade", "GX010129"), ("/o/GX1_detectron2_results.csv", "detectron2", "GX1"),
        ("/o/GX1_farneback_dense.csv", "farneback", "GX1"), ("/o/opencv/GX010130_frames.csv", "opencv", "GX010130"),
    ]


def test_success_words(spark):
    from signalframe.operators.extraction import succeeded

    rows = spark.createDataFrame([(x,) for x in (" OK ", "yes", "2", "0", "-1", "Detected", None, "true")], "c string")
    assert [r[0] for r in rows.select(succeeded(F.col("c"))).collect()] == [True, False, True, False, False, True, False, True]


def test_annotation_files_give_shapes(spark, tmp_path):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]]
    (tmp_path / "frame_1.json").write_text(json.dumps({"shapes": [{"label": "a_inner_pipe", "points": square}, {"label": "a_particle_bed", "points": square[:2]}, {"label": "dirt", "points": square}], "imageHeight": 9, "imageWidth": 8}))
    (tmp_path / "frame_2.json").write_text(json.dumps({"shapes": [], "imageHeight": 9, "imageWidth": 8}))
    rows = extraction.shape_counts(tables.read_shapes(spark, str(tmp_path)), F.size("points"), ["frame"])
    found = {r["frame"]: tuple(r)[1:] for r in rows.collect()}
    assert found == {"frame_1": (1, 0, 1, 1, False), "frame_2": (0, 0, 0, 0, True)}


def test_signal_without_a_time_column_takes_the_rate(spark, tmp_path):
    (tmp_path / "a.csv").write_text("liny\n" + "\n".join(["1", "2", "x", "4"]))
    with pytest.raises(ValueError):
        tables.read_signal(spark, str(tmp_path / "a.csv"))
    rows = tables.read_signal(spark, str(tmp_path / "a.csv"), rate=2.0)
    assert sorted(map(tuple, rows.collect())) == [(0.0, 1.0), (0.5, 2.0), (1.5, 4.0)]


def test_signal_keeps_the_first_of_each_time(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time,linx,liny\n7,9,3\n5,9,1\n5,9,2\n6,9,\n")
    rows = tables.read_signal(spark, str(tmp_path / "b.csv"), values=("liny",))
    assert sorted(map(tuple, rows.collect())) == [(0.0, 1.0), (2.0, 3.0)]


def test_time_is_chosen_by_what_parses(spark):
    def chosen(columns, rows, **k):
        df, name = tables.with_time(spark.createDataFrame(rows, columns), **k)
        return name, [r.t for r in df.orderBy("n").collect()]

    rows = [(0, "x", "2022-04-17", "10:00:01.5", "5", 3), (1, None, "2022-04-17", "10:00:02", "6.5", 4), (2, "1", "bad", "10:00:04", "z", 6)]
    columns = "n int, Time_Seconds string, day string, time string, t string, frame int"
    assert chosen(columns, rows) == ("day+time", [0.0, 0.5, None])  # one number in time_seconds is too few
    assert chosen(columns, rows, requested="t") == ("t", [0.0, 1.5, None])
    assert chosen(columns, rows, requested="t", relative=False) == ("t", [5.0, 6.5, None])
    with pytest.raises(ValueError, match="neither"):
        chosen(columns, rows, requested="Time_Seconds")
    with pytest.raises(ValueError, match="missing"):
        chosen(columns, rows, requested="q")
    assert chosen("n int, day string, frame int", [(0, "a", 3), (1, "b", 5)], rate=2.0) == ("frame", [1.5, 2.5])
    assert chosen("n int, timestamp string", [(0, "2022-04-17 10:00:00"), (1, "2022-04-17 10:01:00")], candidates=tables.VIDEO_TIMES) == ("timestamp", [0.0, 60.0])
    assert chosen("n int", [(0,), (7,), (9,)], rate=4.0, order="n") == (None, [0.0, 0.25, 0.5])
    with pytest.raises(ValueError, match="no time"):
        chosen("n int", [(0,)])
    assert chosen("n int, time_seconds double", [(0, 4.0), (1, float("nan")), (2, 5.0)]) == ("time_seconds", [0.0, None, 1.0])


def test_video_metadata_and_ids(spark):
    df = spark.createDataFrame([("/v/gx010129_x.mp4", "100", "a"), ("GX010129", "7", "30"), ("cam.two.avi", "5", "2.5"), ("cam.3", None, "1"), (None, "3", "1")], "file_name string, frames string, fps string").coalesce(1)
    assert sorted(tuple(r) for r in tables.video_metadata(df).collect()) == [("CAM.TWO", 5, 2.5), ("GX010129", 100, None)]
    with pytest.raises(ValueError, match="number of frames"):
        tables.video_metadata(df.drop("frames"))
    paths = spark.createDataFrame([("/a/run_2022-04-17_10.20.30_x/data.csv",), ("/a/other/data.csv",), ("data.csv",)], "p string")
    found = [tuple(map(str, r)) for r in paths.select(scalars.measurement_id(F.col("p")), scalars.measurement_time(F.col("p"))).collect()]
    assert found == [("2022-04-17_10.20.30", "2022-04-17 10:20:30"), ("other", "None"), ("", "None")]


def test_csv_sink_keeps_its_order(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 0.5, None)], "a int, b double, c string")
    tables.write_csv(df.coalesce(1), ["c", "a", "b"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines() == ["c,a,b", "x,1,", ",2,0.5"]
    with pytest.raises(ValueError, match="missing"):
        tables.write_csv(df, ["d"], str(tmp_path / "no"))


def test_runs_neither_lose_nor_double_keys(spark, tmp_path):
    path = str(tmp_path / "runs")
    wanted = spark.range(6).withColumnRenamed("id", "video")
    assert tables.committed(spark, path, "video") is None and tables.resume_run(wanted, path, "video").count() == 6
    tables.stage_run(wanted.where("video < 3").withColumn("v", F.lit(1)), path, "a")
    assert tables.resume_run(wanted, path, "video").count() == 6  # killed before its commit
    tables.stage_run(wanted.where("video < 2").withColumn("v", F.lit(2)), path, "a")  # the second attempt
    assert tables.commit_run(spark, path, "a") == 2 and tables.commit_run(spark, path, "a") == 2
    todo = tables.resume_run(wanted, path, "video")
    assert sorted(r.video for r in todo.collect()) == [2, 3, 4, 5]
    tables.stage_run(todo.withColumn("v", F.lit(3)).withColumn("more", F.lit("m")), path, "b")
    tables.stage_run(wanted.where("video in (1, 5)").withColumn("v", F.lit(9)), path, "c")  # beside it, with a key of each
    for run in "bc":
        tables.commit_run(spark, path, run)
    tables.stage_run(wanted.withColumn("v", F.lit(7)), path, "d")  # never committed
    rows = tables.committed(spark, path, "video").collect()
    assert sorted((r.video, r.v, r.run) for r in rows) == [(0, 2, "a"), (1, 2, "a"), (2, 3, "b"), (3, 3, "b"), (4, 3, "b"), (5, 3, "b")]
    assert tables.resume_run(wanted, path, "video").count() == 0 and {r.more for r in rows} == {None, "m"}
