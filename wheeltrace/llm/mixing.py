"""Mixing sources to target weights: blocks of words, multinomial source counts per shard, permuted block indices.

The words of each source, document after document, form fixed-length blocks. Sources share the words of the mix by
weight, none above `max_repeats` times its own words (the excess goes to the others by weight). Each output shard draws
its sources' slot counts from a multinomial over the sources' shares of all slots; these draws alone decide how many slots a
source gets, so its words come near its target, nearer with more shards: with n slots of a share p, the standard deviation
is sqrt((1 - p) / (n p)) of the target. A source's n-th slot over all shards takes the block that a pseudorandom permutation of
its block indices gives for n, pass after pass, and texts, cut into blocks, join the slots by block index. A draw beyond
`max_repeats` passes over a source finds no block and falls away, so no text is taken more often than that; the shard is as much
shorter. Inside a shard the sources' slots are permuted.

Null texts have size 0 and are never taken. A null source is a source of its own, after the others. Repeated rows count
each on its own. Positions inside a source are running sums within hashed buckets plus the buckets' own running sums, so a
source with a third of all rows, or rows that all have one id or none, are no single task. Rows are ordered by bucket, id, size and a hash of the
text; rows that tie in all of these have equal texts, so that it does not matter which comes first. A very long text is cut into as many
blocks as it fills, one row each. An empty table gives no rows. Draws depend on the seed, the shard and the
data only: reruns agree. Columns of the input may have any names. The table of sources (a row for each distinct value) is
collected and broadcast up to MAX_SOURCES; a column with more values is no source column and is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

WEIGHTS = (5.0, 2.0, 1.0)  #: repeating, over the sources in code-point order
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 2048
SEED = 17
MAX_SOURCES = 100_000  #: distinct sources that the driver plans for


@dataclass
class Source:
    """One source's share of the mix: its words, the words that it should give, its blocks, and its share of all slots."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    share: float = 0.0


def permute(i: np.ndarray, n: int, seed: int, number: int, *, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F + r * 0x165667B19E3779F9) % (1 << 64)) for r in range(4)]

    def mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(31)) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ mix(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ mix(right, k)
        return (left << shift) | right

    out = once(np.asarray(i, np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int) -> list[float]:
    """Words of each source: all sizes shared by weight, none above max_repeats times its own."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def plan(sizes: dict[str | None, int], *, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS) -> tuple[list[Source], int]:
    """The sources in code-point order, null last, and the number of slots of the mix. A slot of a source brings the mean
    words of its blocks."""
    names = [*sorted(k for k in sizes if k is not None), *([None] if None in sizes else [])]
    goal = targets([sizes[k] for k in names], [weights[i % len(weights)] for i in range(len(names))], max_repeats)
    out = [Source(i, k, sizes[k], t, -(-sizes[k] // block)) for i, (k, t) in enumerate(zip(names, goal, strict=True))]
    wanted = [s.target * s.blocks / s.size if s.size else 0.0 for s in out]
    for s, n in zip(out, wanted, strict=True):
        s.share = n / max(sum(wanted), 1e-300)
    return out, int(sum(wanted) + 0.5)


def sized(docs: DataFrame, text: str, size: str) -> DataFrame:
    """docs with their numbers of words: runs of anything but ASCII white space."""
    return docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def bucket_sums(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame, dict[str | None, int]]:
    """rows (with _id, _key, _size, _source) with their bucket; the words of each source's buckets, stored; each source's words."""
    buckets = max(1, math.isqrt(n_rows))  # as many buckets as rows of one, so that neither sum is long
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("_id", "_key"), F.lit(buckets)).cast("int"))
    sums = base.Scratch(rows.sparkSession)(rows.groupBy("_source", "bucket").agg(F.sum("_size").alias("held")), "bucket_sums")
    found = sums.groupBy("_source").agg(F.sum("held").alias("n")).limit(MAX_SOURCES + 1).collect()  # a row for each source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return rows, sums, {r["_source"]: int(r.n or 0) for r in found}


def placed(rows: DataFrame, sums: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with source_no, row and start: the words of the source before the row."""
    named = lambda df: df.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("name"))).drop("name")  # noqa: E731  MAX_SOURCES rows at most
    within = W.partitionBy("source_no", "bucket").orderBy("_id", "_size", "_key")
    before = named(sums).withColumn("offset", F.coalesce(F.sum("held").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source_no", "bucket", "offset")
    rows = named(rows).withColumn("row", F.row_number().over(within)).withColumn("start", F.sum("_size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
    return rows.join(before, ["source_no", "bucket"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset")


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame([(s.number, s.name, s.size, s.target) for s in sources], "source_no int, name string, source_size long, target double")


def draws(shards: Sequence[int], sources: Sequence[Source], total: int, seed: int, shard_slots: int) -> np.ndarray:
    """Each shard's slots of each source: a multinomial of shard_slots, of what is left for the last shard."""
    share = np.array([s.share for s in sources])
    return np.array([np.random.default_rng((seed, int(i))).multinomial(min(shard_slots, total - int(i) * shard_slots), share) for i in shards]).reshape(-1, len(sources))


def slots(spark: SparkSession, sources: list[Source], total: int, *, seed: int = SEED, shard_slots: int = SHARD_SLOTS, block: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(shard, slot, source_no, block): every slot of every output shard and the block that it takes."""
    live = [s for s in sources if s.share > 0]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shard, number = np.repeat(pdf["id"].to_numpy(), len(live)), np.tile(np.array([s.number for s in live], np.int32), len(pdf))
            n = draws(pdf["id"].tolist(), live, total, seed, shard_slots).ravel()
            yield pd.DataFrame({"shard": shard, "source_no": number, "n": n})[n > 0]

    schema = "shard long, source_no int, n long"
    drawn = spark.range(-(-total // shard_slots)).mapInPandas(draw, schema) if live else spark.createDataFrame([], schema)
    drawn = drawn.withColumn("part", (F.col("shard") / 1024).cast("int"))
    sums = drawn.groupBy("source_no", "part").agg(F.sum("n").alias("held"))
    before = sums.withColumn("offset", F.coalesce(F.sum("held").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source_no", "part", "offset")
    within = W.partitionBy("source_no", "part").orderBy("shard")
    drawn = drawn.withColumn("first", F.sum("n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).join(before, ["source_no", "part"]).withColumn("first", F.col("first") + F.col("offset"))
    most = spark.createDataFrame([(s.number, max_repeats * s.blocks) for s in live], "source_no int, most long")
    drawn = drawn.join(F.broadcast(most), "source_no").withColumn("n", F.least(F.col("n"), F.col("most") - F.col("first"))).filter("n > 0").select("shard", "source_no", "n", "first")
    own = W.partitionBy("shard")  # a row for each source that the shard drew
    drawn = drawn.withColumn("before", F.sum("n").over(own.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).withColumn("held", F.sum("n").over(own))
    blocks = {s.number: s.blocks for s in live}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, own in pdf.groupby("source_no"):
                counts = own.n.to_numpy()
                within_row = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                g = np.repeat(own["first"].to_numpy(), counts) + within_row
                slot = [permute(b + np.arange(n), h, seed, len(sources) + i) for i, b, n, h in zip(own.shard.tolist(), own.before.tolist(), counts.tolist(), own.held.tolist(), strict=True)]  # sources change places in a shard
                yield pd.DataFrame({"shard": np.repeat(own.shard.to_numpy(), counts), "slot": np.concatenate(slot), "source_no": np.full(len(g), number, np.int32), "block": permute(g % blocks[number], blocks[number], seed, number)})

    return drawn.mapInPandas(spread, "shard long, slot long, source_no int, block long")


def mixed(docs: DataFrame, text: str, source: str, id_col: str, weights: Sequence[float], max_repeats: int, block: int, seed: int, shard_slots: int, *, ordered: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """The mix and the placed rows, whose columns are named _c0, _c1, ... A row of the mix is what one slot takes of one
    row: (shard, slot, source_no, source_name, block, low, start, words, last) and the row's columns, in its text only those words
    with the white space between them; last: whether they end the row's text. ordered: by shard, slot and low, the words of the block before the part."""
    spark = docs.sparkSession
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))  # no name of docs can clash below
    names = plain.columns
    own = dict(zip(docs.columns, names, strict=True))
    rows = sized(plain.select("*", F.col(own[id_col]).alias("_id"), F.xxhash64(F.col(own[text]).cast("string")).alias("_key"), F.col(own[source]).cast("string").alias("_source")), own[text], "_size")
    rows, sums, sizes = bucket_sums(rows, docs.count())
    sources, total = plan(sizes, weights=weights, max_repeats=max_repeats, block=block)
    named = source_table(spark, sources).select("*", F.col("name").alias("source_name"))
    at = placed(rows, sums, named)
    others = [n for n in names if n != own[text]]
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True

    def cut(t: str, start: int) -> list[tuple[int, int, int, bool, str]]:
        """Block, words of the block before the part, words, whether it is the last, and characters of each part of a text."""
        raw = t.encode("utf-8", "surrogatepass")
        held = np.concatenate([[False], ~white[np.frombuffer(raw, np.uint8)], [False]])
        turns = np.flatnonzero(held[1:] != held[:-1])
        begin, end = turns[::2], turns[1::2]
        blocks = np.arange(start // block, (start + len(begin) - 1) // block + 1)
        lo = np.maximum(blocks * block - start, 0)
        hi = np.minimum((blocks + 1) * block - start, len(begin))
        return [(k, start + i - k * block, j - i, j == len(begin), raw[x:y].decode("utf-8", "surrogatepass")) for k, i, j, x, y in zip(blocks.tolist(), lo.tolist(), hi.tolist(), begin[lo].tolist(), end[hi - 1].tolist(), strict=True)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            starts = b.column(1).to_pylist()
            for i, j in base.blocks(texts):
                made = [(r, *part) for r in range(i, j) for part in cut(texts[r], starts[r])]
                row, number, low, words, last, held = map(list, zip(*made, strict=True)) if made else ([], [], [], [], [], [])
                kept = b.select([0, 1, *range(3, b.num_columns)]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int64()), pa.array(low, pa.int64()), pa.array(words, pa.int64()), pa.array(last, pa.bool_()), pa.array(held, pa.string())], names=[*kept.schema.names, "block", "low", "words", "last", "part"])

    from pyspark.sql.types import StructType

    placed_rows = at.filter("_size > 0").select("source_no", "start", own[text], "source_name", *others)
    fields = {f.name: f for f in placed_rows.schema}
    cut_schema = StructType([fields[n] for n in ("source_no", "start", "source_name", *others)]).add("block", "long").add("low", "long").add("words", "long").add("last", "boolean").add("part", "string")
    taken = slots(spark, sources, total, seed=seed, block=block, shard_slots=shard_slots, max_repeats=max_repeats)
    found = placed_rows.mapInArrow(explode, cut_schema).join(taken.hint("merge"), ["source_no", "block"])  # not broadcast: the planner takes slots for as few as draws
    if ordered:
        found = found.orderBy("shard", "slot", "low")
    return found.withColumnRenamed("part", own[text]), at, names


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row for each row of docs: its id, size, source_size, target and taken, its words in the blocks of the mix."""
    parts, at, names = mixed(docs.select(id_col, text, source), text, source, id_col, weights, max_repeats, block, seed, shard_slots, ordered=False)
    taken = parts.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))  # rows with words start at different places
    rows = at.select(F.col(names[0]).alias(id_col), F.col("_size").alias("size"), "source_size", "target", "source_no", F.when(F.col("_size") > 0, F.col("start")).alias("start"))
    return rows.join(taken, ["source_no", "start"], "left").select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_blocks(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, source, block, tokens): the blocks of the mix with their words, one for each slot of each shard."""
    parts, _, names = mixed(docs.select(id_col, text, source), text, source, id_col, weights, max_repeats, block, seed, shard_slots, ordered=False)
    one = parts.groupBy("shard", "slot").agg(F.first("source_name").alias("source"), F.first("block").alias("block"), F.array_sort(F.collect_list(F.struct("low", F.col(names[1]).alias("part")))).alias("parts"))  # at most a row for each word of a block
    return one.select("shard", "slot", "source", "block", F.split(F.array_join("parts.part", " "), r"[ \t-\r]+").alias("tokens"))


def mix_texts(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS, last: str | None = None) -> DataFrame:
    """The texts of the mix's blocks in order of shard and slot, with all columns of docs. A block that several rows share
    gives a row for each, so that id and language stay those of the text. `last` names a column for whether the part ends its row's text."""
    parts, _, names = mixed(docs, text, source, id_col, weights, max_repeats, block, seed, shard_slots, ordered=True)
    return parts.select(*names, *(["last"] if last else [])).toDF(*docs.columns, *([last] if last else []))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(base.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
