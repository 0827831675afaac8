"""Helpers shared by the training-data operators: tables, folds, text blocks, shared storage and label propagation."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are handled in blocks of about this many characters, so that a task's memory does not follow its partition.
BLOCK_CHARS = 1_000_000
#: Rows of an Arrow batch whose texts are Python strings at a time.
SLICE_ROWS = 1_000


def release() -> None:
    """Give memory that a task has freed back to the system. Python workers live on, and what they keep counts against
    their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(batches: Iterator) -> Iterator:
    """The batches as they are; memory is released after the last one."""
    try:
        yield from batches
    finally:
        release()


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of whole texts take much memory on both sides; where the session keeps the default of 10,000 rows,
    set fewer. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read by Spark's own reader."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def sample_fraction(n_rows: int, bound: int) -> float:
    """Share of rows that keeps a sample near `bound` rows."""
    return 1.0 if n_rows <= bound else bound / n_rows


def hash_sample(df: DataFrame, id_col: str, share: float) -> DataFrame:
    """The rows whose id hashes below `share`: the same rows at each run and in any partitioning."""
    if share >= 1.0:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))


def blocks(texts: list[str], max_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of `texts` that hold about `max_chars` characters; a longer text gets a range of its own."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, without copies."""
    for b in released(batches):
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_texts(df: DataFrame, text: str, keep: Sequence[str], schema: str, fn: Callable[[list[str]], Sequence[Sequence]]) -> DataFrame:
    """`keep` columns of each row as they are, and new columns that fn gives for the texts (null: empty), one list for each
    column of `schema`. Kept columns stay in Arrow, so ids keep their type and nulls. fn gets some rows' texts; it
    handles them in blocks itself."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    new = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in new]
    rows = df.select(F.col(text).cast("string").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [pa.array(v, t) for v, t in zip(fn([t or "" for t in b.column(0).to_pylist()]), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], *new.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *new.fields]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a local session, whose
    driver and executors are one process, gets a new folder; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="wheeltrace_shared_")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables that cut lineage: rows are written to the shared folder as Parquet and read again, so that a lost executor costs
    no more than a step. `last` writes a result and deletes the tables that led to it; `drop` deletes one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/wheeltrace_{what}_{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df))[0]
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def last(self, df: DataFrame, what: str) -> DataFrame:
        before = [own for _, own in self.paths.values()]
        out = self(df, what)
        self.drop(*before)
        return out


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the ends of undirected `edges` (a, b): the smallest node that links can reach.

    Minimum labels travel over the links, then along the labels themselves, which halves long chains at each round, so
    rounds grow with the logarithm of the longest chain and always end: labels only ever fall.
    Each round is written to the shared folder. A node with very many links is only ever aggregated (a minimum with
    map-side partials) or joined (AQE splits it); no task gathers its neighbours.
    """
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.select("node", "component").join(near, "node", "left").select("node", F.least("component", "seen").alias("next"), F.col("component").alias("was"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("up"))
        step = step.join(roots, step.next == roots.root, "left").select("node", F.least("next", "up").alias("component"), "was")
        step = scratch(step, "labels")
        scratch.drop(labels)
        labels = step
        if step.filter("component <> was").isEmpty():
            scratch.drop(both)
            return labels.select("node", "component")


def sum_blocks(df: DataFrame, key: str) -> DataFrame:
    """Add up arrays that tasks sent as (key, block, counts binary of int64): one row for each key and block."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf.counts.iloc[0]) // 8, np.int64)
        for raw in pdf.counts:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({key: pdf[key].iloc[:1], "block": pdf.block.iloc[:1], "counts": [total.tobytes()]})

    return df.groupBy(key, "block").applyInPandas(add, df.schema)
