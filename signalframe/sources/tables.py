"""Readers of recordings, archives and summaries, and writers of results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signalframe.functions.scalars import finite, moment, number, or_null, stem, video_id
from signalframe.operators import blocks
from signalframe.operators.filters import require, valid_rows

AXES = ("linx", "liny", "linz", "rotx", "roty", "rotz")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, ORC, JSON or delimited table by its suffix; the delimiter is the one that the header holds most of."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    delimiter = max(",;\t|", key=line.count)
    return spark.read.option("header", True).option("sep", delimiter).csv(path)


def read_track(spark: SparkSession, path: str, column: str, valid_only: bool = True) -> DataFrame:
    """Time and one column of a track table as t, value: valid rows, finite numbers. Repeated times are an error."""
    rows = require(read_table(spark, path), "time_seconds", column)
    rows = valid_rows(rows, "inner_pipe_track_valid", "valid_point_count") if valid_only else rows
    rows = rows.select(number(F.col("time_seconds")).alias("t"), number(F.col(column)).alias("value"))
    rows = rows.where(finite(F.col("t")) & finite(F.col("value")))
    repeated = rows.groupBy("t").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"{path}: repeated times")
    return rows


def read_archive(spark: SparkSession, root: str, name: str = "data.csv", day: str | None = None) -> DataFrame:
    """All files of that name below root, white-space separated with day, time and six axes: path, at, and the axes.

    Lines without a time or with fewer fields are kept with nulls; see split_failures. day keeps paths that contain it.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    if day:
        lines = lines.where(F.col("path").contains(day))
    parts = F.split("line", r"\s+")
    rows = lines.where("line <> '' and not line like 'day%'").withColumn("_p", parts)
    field = lambda i: F.get("_p", F.lit(i))
    return rows.select("path", moment(field(0), field(1)).alias("at"), *[number(field(i + 2)).alias(a) for i, a in enumerate(AXES)])


def long_signals(archive: DataFrame) -> DataFrame:
    """source_id, axis, t (seconds since the first time of the file), value of the finite samples."""
    first = archive.groupBy("path").agg(F.min("at").alias("_first"))
    rows = archive.join(first, "path").withColumn("t", F.expr("timestampdiff(MICROSECOND, _first, at)") / 1e6)
    rows = rows.unpivot(["path", "t"], list(AXES), "axis", "value").withColumnRenamed("path", "source_id")
    return rows.where(finite(F.col("t")) & finite(F.col("value")))


def numbered(df: DataFrame, out: str = "idx") -> DataFrame:
    """df with the place of each row, from 0 in the order of its files and splits; only one count a split is gathered."""
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(starts, "_part").withColumn(out, F.col("_from") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_from")


def read_signal(spark: SparkSession, path: str, values: Iterable[str] = AXES, time_column: str | None = None, rate: float | None = None) -> DataFrame:
    """t (seconds from the first), value of a comma-separated file: finite samples, the first of each time.

    The value is the first known column of `values`. Time is time_column, else inferred; where there is none and a sample
    rate is given, it is the row's place over the rate.
    """
    df = read_table(spark, path)
    value = next((c for c in values if c in df.columns), None)
    if value is None:
        raise ValueError(f"{path}: none of {list(values)} is a column")
    try:
        if time_column and time_column not in df.columns:
            raise ValueError(f"{path}: no column {time_column}")
        time = number(F.col(time_column)) if time_column else infer_time(df)
    except ValueError:
        if not rate or rate <= 0:
            raise
        time = F.col("idx") / rate
    rows = numbered(df).select("idx", time.alias("t"), number(F.col(value)).alias("value")).where(finite(F.col("t")) & finite(F.col("value")))
    once = rows.groupBy("t").agg(F.min_by("value", "idx").alias("value"))
    return once.crossJoin(once.agg(F.min("t").alias("_first"))).select((F.col("t") - F.col("_first")).alias("t"), "value")


#: Fixed fields of an annotation file that the shapes need.
ANNOTATION = "shapes array<struct<label: string, points: array<array<double>>, shape_type: string>>, imageHeight long, imageWidth long"


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """One row per shape of the annotation files below path: frame (the file's name), label, points, height, width.

    A file without shapes is one row with a null label, so that it is counted as empty.
    """
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return rows.select(name.alias("frame"), F.explode_outer("shapes").alias("s"), F.col("imageHeight").alias("height"), F.col("imageWidth").alias("width")).select("frame", "s.label", "s.points", "height", "width")


def infer_time(df: DataFrame, fps: float | None = None) -> Column:
    """Seconds from the first usable of: time_seconds, time or timestamp as numbers, day and time, frame / fps."""
    names = {c.lower(): c for c in df.columns}
    for c in ("time_seconds", "t", "seconds"):
        if c in names:
            return number(F.col(names[c]))
    if "day" in names and "time" in names:
        return F.unix_micros(moment(F.col(names["day"]), F.col(names["time"])).cast("timestamp")) / 1e6
    for c in ("time", "timestamp"):
        if c in names:
            return F.coalesce(number(F.col(names[c])), F.unix_micros(F.col(names[c]).try_cast("timestamp")) / 1e6)
    if "frame" in names and fps:
        return number(F.col(names["frame"])) / fps
    raise ValueError("no time column")


#: Fixed names of time columns, in the order in which they are tried; two names are a day and a time.
SENSOR_TIMES = ("time_seconds", ("day", "time"), "time", "timestamp", "writetime", "t")
VIDEO_TIMES = ("time_s", "time", "timestamp_s", "timestamp", "t", "seconds", "elapsed_time_s", "relative_time_s")
FRAMES = ("frame", "frame_idx", "frame_index", "frame_id")


def with_time(df: DataFrame, candidates: Iterable[str | tuple[str, str]] = SENSOR_TIMES, requested: str | None = None, rate: float | None = None, order: str | None = None, relative: bool = True, out: str = "t") -> tuple[DataFrame, str | None]:
    """df with seconds in `out`, and the name of their source; chosen by what the columns hold.

    One pass counts, for every candidate that df has (in any case of letters), the values that are numbers and those that are time stamps. The first
    candidate with two numbers counts as numbers, with two time stamps else as seconds since the earliest one; numbers are made
    relative to the smallest with `relative`. A requested column must do. Without any, a frame number over `rate` is the time, or the place by the number column
    `order` (without ties) over `rate`; it is an error if these lack too. Values that do not parse are null.
    """
    names = {c.lower(): c for c in df.columns}
    wanted = [requested] if requested else list(candidates)
    if requested:
        require(df, requested)
    there = [c for c in wanted if all(x.lower() in names for x in ((c,) if isinstance(c, str) else c))]

    def real(c: Column) -> Column:
        return F.when(~F.isnan(number(c.cast("string"))), number(c.cast("string")))

    def parsed(c: str | tuple[str, str]) -> tuple[Column, Column]:
        texts = [F.trim(F.col(f"`{names[x.lower()]}`").cast("string")) for x in ((c,) if isinstance(c, str) else c)]
        stamp = texts[0].try_cast("timestamp_ntz") if len(texts) == 1 else moment(*texts)
        return (real(texts[0]) if len(texts) == 1 else F.lit(None).cast("double")), stamp

    columns = [parsed(c) for c in there]
    if columns:
        seen = df.agg(*[f(x).alias(f"{n}{i}") for i, pair in enumerate(columns) for n, f, x in (("n", F.count, pair[0]), ("m", F.min, pair[0]), ("s", F.count, pair[1]), ("e", F.min, pair[1]))]).first()
        for i, (name, (value, stamp)) in enumerate(zip(there, columns, strict=True)):
            label = name if isinstance(name, str) else "+".join(name)
            if seen[f"n{i}"] >= 2:
                return df.withColumn(out, value - seen[f"m{i}"] if relative else value), label
            if seen[f"s{i}"] >= 2:
                return df.withColumn(out, F.timestamp_diff("MICROSECOND", F.lit(seen[f"e{i}"]).cast("timestamp_ntz"), stamp) / 1e6), label
    if requested:
        raise ValueError(f"{requested} holds neither numbers nor time stamps")
    frame = next((names[c] for c in FRAMES if c in names), None)
    if frame and rate:
        return df.withColumn(out, real(F.col(f"`{frame}`")) / rate), frame
    if order and rate:
        return blocks.numbered(df, [], order, "_place", 1e6).withColumn(out, F.col("_place") / rate).drop("_place"), None
    raise ValueError("no time column, and no rate for frames or rows")


#: Fixed names under which a mapping holds its times and its values.
MAPPED_TIMES = ("time", "time_s", "timestamps", "timestamp", "t")
MAPPED_VALUES = ("values", "signal", "data", "displacement", "acceleration")


def to_signal(spark: SparkSession, loaded: object, name: str, time_column: str | None = None, value_column: str | None = None, rate: float | None = None, order: str | None = None, relative: bool = False) -> DataFrame:
    """What a loader returned, as one table of finite samples: axis (the name), t, value.

    A DataFrame keeps its rows: t by with_time, which measures numbers from the smallest with `relative` and time stamps always; the value is value_column, else the first column with two numbers that is
    neither time nor `order`. A mapping with times and values under a fixed name, value_column or the signal's name, a pair (times, values),
    or an object with both as attributes is a local sample and must be of equal lengths. Anything else is a TypeError.
    """
    if isinstance(loaded, DataFrame):
        rows, source = with_time(loaded, requested=time_column, rate=rate, order=order, relative=relative, out="_t")
        taken = {*(source or "").split("+"), order}
        if value_column:
            chosen = require(loaded, value_column) and value_column
        else:
            free = [c for c in loaded.columns if c not in taken and c.lower() not in {str(x).lower() for x in taken}]
            seen = loaded.agg(*[F.count(number(F.col(f"`{c}`").cast("string"))).alias(f"n{i}") for i, c in enumerate(free)]).first() if free else []
            chosen = next((c for c, n in zip(free, seen, strict=True) if n >= 2), None)
            if chosen is None:
                raise ValueError(f"no column of numbers among {loaded.columns}")
        rows = rows.select(F.col("_t").alias("t"), number(F.col(f"`{chosen}`").cast("string")).alias("value"))
    else:
        if isinstance(loaded, Mapping):
            pick = lambda names: next((loaded[k] for k in names if k and k in loaded), None)
            times, values = pick(MAPPED_TIMES), pick((value_column, *MAPPED_VALUES, name))
        elif isinstance(loaded, tuple | list) and len(loaded) >= 2:
            times, values = loaded[:2]
        else:
            times, values = getattr(loaded, "time", None), getattr(loaded, "values", None)
        if times is None or values is None or callable(values):
            raise TypeError(f"{name}: no times and values in a {type(loaded).__name__}")
        pairs = [(None if t is None else float(t), None if v is None else float(v)) for t, v in zip(times, values, strict=True)]
        rows = spark.createDataFrame(pairs, "t double, value double")
    return rows.where(finite(F.col("t")) & finite(F.col("value"))).select(F.lit(name).alias("axis"), "t", "value")


#: Fixed aliases of the columns of video metadata.
METADATA = {"video_id": ("video_id", "video", "stem", "name", "filename", "file_name"), "num_frames": ("num_frames", "nb_frames", "frames", "frame_count"), "fps": ("fps", "frame_rate", "sampling_rate")}


def video_metadata(df: DataFrame) -> DataFrame:
    """video_id, num_frames, fps: the columns by their fixed aliases, ids as GX and digits where the name has them, else the stem in upper case; the first row of each id with a number of frames."""
    chosen = {out: next((c for c in options if c in df.columns), None) for out, options in METADATA.items()}
    if not chosen["video_id"] or not chosen["num_frames"]:
        raise ValueError(f"no video id or number of frames among {df.columns}")
    name = F.upper(stem(F.col(chosen["video_id"]).cast("string")))
    fps = number(F.col(chosen["fps"]).cast("string")) if chosen["fps"] else F.lit(None).cast("double")
    rows = df.select(F.coalesce(video_id(name, name), name).alias("video_id"), number(F.col(chosen["num_frames"]).cast("string")).cast("long").alias("num_frames"), fps.alias("fps"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.where("video_id is not null and num_frames is not null")
    return rows.groupBy("video_id").agg(F.min_by(F.struct("num_frames", "fps"), "_at").alias("_r")).select("video_id", "_r.*")


#: Fixed names of the methods' result files, and tokens of files that are none.
RESULT_FILES = {"_lucas_kanade.csv": "lucas_kanade", "_farneback_dense.csv": "farneback", "_detectron2_results.csv": "detectron2"}
CLASSICAL = ("opencv", "classical", "classic_seg")
AUXILIARY = ("benchmark", "summary", "timeseries", "acceleration", "comparison", "metrics", "report")


def result_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths of the methods' result files with method and video id, by the fixed rules of their names.

    Only CSV files count, and no auxiliary ones. The three suffixes come first; other files are classical results where the
    path names that method and has a video id.
    """
    rows = files.select(F.col(path).alias("path")).distinct()
    lower = F.lower("path")
    name = F.element_at(F.split(lower, "/"), -1)
    rows = rows.where(F.endswith(lower, F.lit(".csv")) & ~name.rlike("|".join(AUXILIARY)) & ~F.contains(lower, F.lit("extraction_success_all_methods")))
    ident = video_id(F.element_at(F.split("path", "/"), -1), F.col("path"))
    method = F.when(F.lit(False), "")
    for suffix, known in RESULT_FILES.items():
        method = method.when(F.endswith(name, F.lit(suffix)), known)
    method = method.when(lower.rlike("|".join(CLASSICAL)) & ident.isNotNull(), "opencv")
    return rows.select("path", method.alias("method"), ident.alias("video_id")).where("method is not null")


def inventory(spark: SparkSession, root: str, suffixes: Iterable[str]) -> DataFrame:
    """path, length and modification time of the files below root with one of the suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    test = F.lit(False)
    for s in suffixes:
        test = test | F.lower("path").endswith(s)
    return files.where(test)


def first_known(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Columns by their first present alias that is not blank; columns without one are null."""
    names = {c.lower(): c for c in df.columns}
    picked = {}
    for out, options in aliases.items():
        found = [F.nullif(F.trim(F.col(names[o.lower()]).cast("string")), F.lit("")) for o in options if o.lower() in names]
        picked[out] = F.coalesce(*found) if found else F.lit(None).cast("string")
    return df.select(*[c.alias(out) for out, c in picked.items()])


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls in all floating columns, as JSON wants them."""
    return df.withColumns({c: or_null(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def write_json(df: DataFrame, path: str) -> None:
    finite_only(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV files with a header and the columns in the given order; NaN and infinities are empty, and so is null. A column that df lacks is an error."""
    finite_only(require(df, *columns).select(*columns)).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, keys: list[str], metrics: list[str], path: str) -> None:
    """Wide metrics as (keys, metric, value) rows."""
    df.unpivot(keys, metrics, "metric", "value").write.mode("overwrite").parquet(path)


def write_stages(stages: Mapping[str, DataFrame], path: str) -> None:
    """Snapshots of several stages in one table, partitioned by stage."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{path}/stage={name}")


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key has no result yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def append_new(results: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at path lacks; returns how many."""
    spark = results.sparkSession
    try:
        fresh = todo(results, spark.read.parquet(path), key)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = results
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def stage_run(results: DataFrame, path: str, run: str) -> None:
    """Write a run's results under its id; they count for nothing until commit_run. A repeated attempt replaces what an earlier one left."""
    results.write.mode("overwrite").parquet(f"{path}/data/run={run}")


def commit_run(spark: SparkSession, path: str, run: str) -> int:
    """Enter a staged run into the manifest, which is what makes its rows visible; returns how many they are. To commit again changes nothing."""
    n = spark.read.parquet(f"{path}/data/run={run}").count()
    spark.createDataFrame([(n,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/run={run}")
    return n


def committed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows of all committed runs with their run; of a key in several runs only those of the run that comes first by id. None before the first commit."""
    manifest = f"{path}/manifest"
    folder = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else []
    names = [p.getName() for p in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not names:
        return None
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).schema(merged_schema(spark, path, names)).parquet(*[f"{path}/data/{n}" for n in names])
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("run").alias("_run"))
    return rows.join(first, rows[key].eqNullSafe(F.col("_key")) & (F.col("run") == F.col("_run"))).drop("_key", "_run")


def merged_schema(spark: SparkSession, path: str, names: list[str]):
    """The runs' columns in order of appearance, and the run as text."""
    fields: dict[str, object] = {}
    for n in names:
        for f in spark.read.parquet(f"{path}/data/{n}").schema.fields:
            fields.setdefault(f.name, f)
    return StructType([*fields.values(), StructField("run", StringType())])


def resume_run(wanted: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of wanted whose key no committed run has; staged and lost attempts count for nothing."""
    done = committed(wanted.sparkSession, path, key)
    return wanted if done is None else todo(wanted, done, key)


def split_failures(df: DataFrame, tests: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, failed): failed rows carry the names of the tests they fail in `error`."""
    errors = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()])
    rows = df.withColumn("error", errors)
    return rows.where("error = ''").drop("error"), rows.where("error <> ''")


def flattened(df: DataFrame) -> DataFrame:
    """Nested struct columns as columns with dotted names."""
    out: list[Column] = []

    def walk(schema, path: list[str]) -> None:
        for field in schema.fields:
            here = [*path, field.name]
            if hasattr(field.dataType, "fields"):
                walk(field.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))

    walk(df.schema, [])
    return df.select(*out)
