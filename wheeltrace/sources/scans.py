"""Tolerant scans: route discovery, signal files with defaults, metadata, file flags and caches as tables.

Files are listed and read by Spark's own readers, so any store that Spark can open will do. Signal files are read as text
columns and conformed to a fixed schema: a missing file or column takes its default, and no schema is inferred.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MODALITIES, SIGNAL_DEFAULTS
from ..functions.numeric import number
from ..operators.lineage import cut

METADATA = T.StructType([
    T.StructField("dongle_id", T.StringType()), T.StructField("route_id", T.StringType()), T.StructField("car_model", T.StringType()),
    T.StructField("total_duration_s", T.DoubleType()), T.StructField("n_segments", T.IntegerType()),
    T.StructField("initData", T.StructType([T.StructField("version", T.StringType()), T.StructField("deviceType", T.StringType())])),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("seg_num", T.IntegerType()), T.StructField("duration_s", T.DoubleType())]))),
    T.StructField("segment_range", T.ArrayType(T.IntegerType())),
])
SPLIT = T.StructType([T.StructField(f"{p}_routes", T.ArrayType(T.StringType())) for p in ("train", "val", "test")] + [T.StructField("split_type", T.StringType())])
RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("run_name", "task", "modality", "model", "split")] + [T.StructField("horizon", T.DoubleType()), T.StructField("seed", T.LongType()), T.StructField("test_metrics", T.MapType(T.StringType(), T.DoubleType())), T.StructField("val_metrics", T.MapType(T.StringType(), T.DoubleType()))])


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path, counted from its end (1 is the file's name)."""
    return F.element_at(F.split(path, "/"), -from_end)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, dir, name, length) of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), path_part(F.col("path"), 1).alias("name"), "length")


def conform(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, float] = SIGNAL_DEFAULTS) -> DataFrame:
    """df with exactly these numeric columns (and what comes before them): missing ones and unreadable values take their
    default, 0 if none is named."""
    have = set(df.columns)
    return df.select(*(c for c in df.columns if c not in columns), *((number(F.col(c), defaults.get(c, 0.0)) if c in have else F.lit(defaults.get(c, 0.0))).alias(c) for c in columns))


def cells(line: Column) -> Column:
    """The cells of a line of comma-separated values; quotes around a cell go, doubled ones inside become one."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda x: F.when(x.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(x))


CSV = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
#: A table of file blocks with at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 100_000


HEAD_LINES = 100  #: a header's cells with line breaks end within so many lines


def headers(spark: SparkSession, root: str, pattern: str) -> list[tuple[list[str], bool, list[str]]]:
    """(names, whether a quoted cell goes on over a line break, paths) of the files below root that match: one scan, of which a row for each file
    is left. Paths stand on the driver, as they do in Spark's own file listing; they are grouped by their first line."""
    import csv

    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).filter("value <> ''")
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    each = lines.groupBy("path").agg(F.min_by("value", "at").alias("head"), F.bool_or(odd).alias("broken"))
    place = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    own = F.when((F.length("head") - F.length(F.replace("head", F.lit('"'), F.lit("")))) % 2 == 1, F.col("path"))  # the header itself goes on
    groups = each.groupBy("head", "broken", own.alias("own")).agg(F.sort_array(F.collect_list(place)).alias("paths"))
    found = []
    for r in groups.orderBy("head", "own").collect():
        first = [r.head] if r.own is None else [x.value + "\n" for x in lines.filter((F.col("path") == r.own) & F.col("at").isNotNull()).orderBy("at").limit(HEAD_LINES).collect()]
        found.append((next(csv.reader(first)), r.broken, r.paths))
    return found


def csv_rows(spark: SparkSession, root: str, pattern: str, columns: Sequence[str]) -> DataFrame:
    """(path, i, columns as text) of the files below root that match: columns by name, missing ones null; i is the row's place in its file.

    Files are grouped by their header, and each group is read by Spark's own CSV reader, which splits large files over tasks
    and takes quoted cells of any number and length; a file with a line break in quotes is one task. No line of a file is
    shuffled: its place is its place in its block and the rows of the blocks before, counted in one more scan of no columns."""
    parts = []
    for names, broken, paths in headers(spark, root, pattern):
        safe = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
        reader = spark.read.options(**CSV).option("header", True).option("multiLine", broken)
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
        rows = reader.schema(schema).option("enforceSchema", True).option("maxColumns", max(len(names) + 1, 20_480)).csv(safe)
        where = {c: f"c{k}" for k, c in reversed(list(enumerate(names)))}  # of columns with one name the first
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *((F.col(where[c]) if c in where else F.lit(None).cast("string")).alias(c) for c in columns))
        held = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        blocks = cut(held.select("path", "block", (before - F.col("first")).alias("shift")))
        blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
        parts.append(rows.join(blocks, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("i"), *columns))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("i", T.LongType())] + [T.StructField(c, T.StringType()) for c in columns]))
    return reduce(DataFrame.union, parts)


def signals(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """(dir, i, time_s, columns) of one modality's files below root. Headers are matched by name; rows without a readable
    time go. i is the row's place in its file."""
    columns = MODALITIES[modality]
    table = csv_rows(spark, root, f"{modality}.csv", ["time_s", *(c for c in columns if c != "time_s")])
    table = table.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "i", F.col("time_s").try_cast("double").alias("time_s"), *columns)
    if "laneChangeState" in columns:  # an enumeration: 0 for off and empty, else 1
        state = F.coalesce(F.nullif("laneChangeState", F.lit("")), F.lit("off"))
        table = table.withColumn("laneChangeState", F.when(state == "off", 0.0).otherwise(1.0))
    return conform(table.filter("time_s is not null"), columns)


def with_sentinels(routes: DataFrame, stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """stream with one row of defaults at time 0 for each route that has no file of this kind."""
    lone = routes.select("dir").join(stream.select("dir").distinct(), "dir", "left_anti").select("dir", F.lit(0).alias("i"), F.lit(0.0).alias("time_s"), *(F.lit(SIGNAL_DEFAULTS.get(c, 0.0)).alias(c) for c in columns))
    return stream.unionByName(lone)


def routes(spark: SparkSession, root: str) -> DataFrame:
    """Routes by their metadata files: ids, model, duration, versions and segments; absent keys take their default. The
    path is the key, as ids need not be unique."""
    meta = spark.read.schema(METADATA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root).select("*", F.col("_metadata.file_path").alias("path"))
    return meta.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.concat_ws("/", "dongle_id", "route_id").alias("route_id"), F.coalesce("dongle_id", F.lit("unknown")).alias("driver_id"), F.coalesce("car_model", F.lit("unknown")).alias("vehicle_model"), F.coalesce("total_duration_s", F.lit(0.0)).alias("duration_sec"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("initData.version", F.lit("unknown")).alias("op_version"), F.coalesce("initData.deviceType", F.lit("unknown")).alias("device_type"), F.coalesce("segments", F.array().cast("array<struct<seg_num:int,duration_s:double>>")).alias("segments"), "segment_range")


def modality_flags(files: DataFrame) -> DataFrame:
    """(dir, has_...) by the files of each folder; the cabin camera's file lies one folder up."""
    kinds = {"has_qcamera": "qcamera.mp4", "has_radar": "radar.csv", "has_driver_state": "driver_state.csv", "has_gps": "gps.csv", "has_imu": "imu.csv", "has_planning": "planning.csv"}
    own = files.groupBy("dir").agg(*(F.max((F.col("name") == name).cast("int")).alias(flag) for flag, name in kinds.items()))
    cabin = files.filter(F.col("name").like("%dcamera.hevc")).select(F.col("dir").alias("_up")).distinct()
    return own.withColumn("_up", F.regexp_replace("dir", "/[^/]*$", "")).join(cabin.withColumn("_c", F.lit(1)), "_up", "left").withColumn("has_dcamera", F.coalesce("_c", F.lit(0))).drop("_up", "_c")


def video_sources(files: DataFrame, *, priority: Sequence[tuple[str, int]]) -> DataFrame:
    """(dir, kind, segment, path): for each folder the files of the first kind (name pattern, least length) that it has,
    with the segment's number from the start of the name."""
    kind = F.lit(None).cast("int")
    for i, (pattern, least) in reversed(list(enumerate(priority))):
        kind = F.when(F.col("name").rlike(pattern) & (F.col("length") > least), i).otherwise(kind)
    best = files.withColumn("kind", kind).filter("kind is not null").withColumn("_b", F.min("kind").over(W.partitionBy("dir"))).filter("kind = _b")
    return best.select("dir", "kind", F.nullif(F.regexp_extract("name", r"^(\d+)--", 1), F.lit("")).try_cast("int").alias("segment"), "path")


def first_path(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first path of each key, in binary order."""
    return files.groupBy(*keys).agg(F.min("path").alias("path"))


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(split_type, part, route_id) of split files."""
    s = spark.read.schema(SPLIT).option("multiLine", True).json(path)
    parts = [s.select("split_type", F.lit(p).alias("part"), F.explode(f"{p}_routes").alias("route_id")) for p in ("train", "val", "test")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """Result files below root, one row for each run."""
    return spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)


def within_box(nodes: DataFrame, box: DataFrame, cell: float = 0.05) -> DataFrame:
    """Road nodes (x, y as degrees) inside each route's box; boxes are one row for each route. Boxes go to all cells of a grid
    that they touch, nodes to one, so this is an equal join."""
    at = lambda c: F.floor(F.col(c) / cell)
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    b = box.withColumn("_cx", span("west", "east")).withColumn("_cy", span("south", "north"))
    inside = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    return nodes.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(b, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy")
