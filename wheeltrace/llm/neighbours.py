"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

Candidates are parted by norm into ranges of a factor of the root of two; each range has buckets of its own, so a long vector
does the others no harm. Vectors are brought to unit length (where norms differ, one more coordinate makes the largest inner product of a
range the smallest angle), padded to a power of two and turned by three rounds of random signs and a fast Hadamard transform; the
nearest signed axis is a hash. A table concatenates several hashes, as many as its number of buckets asks for, which follows the number of
rows: a query looks into the `probes` buckets of each table that its coordinates jointly rank first, and these hold about
ROWS * n ** GROWTH rows. So the share of all rows that a query meets falls as rows grow.
Inner products with the original vectors, in double precision, rank what it finds. A query that finds fewer than k is
compared with all rows, tile by tile.

Measured recall against brute force, beside the share of pairs scored, is in the README and in a test. All rows are indexed. Of identical vectors only the k + 1 smallest
ids can rank, so no more are indexed. Buckets beyond a tile's size are dealt over tiles of candidates and of queries, which
meet pair by pair. A bounded sample gives each query a floor below which nothing can rank; it only saves shuffling.
Vectors that are null, empty, zero or hold null or non-finite components take no part; shorter vectors count as padded with
zeros. Rows with the query's own id are not its candidates. Ties go to the smaller id; a repeated id is one candidate, with its best score. An empty table gives no rows. Only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

TABLES, PROBES, SEED = 12, 48, 5
ROWS, GROWTH = 1.0, 0.65  #: a query meets about ROWS * n ** GROWTH rows in each table
TILE_CANDIDATES, TILE_QUERIES = 20_000, 4_000
SAMPLE = 4_000  #: bound of the sample that gives floors
FLOOR_RANK, FLOOR_SHARE = 5, 10  #: a floor is the sample's value of a rank that about FLOOR_SHARE x k candidates exceed, and FLOOR_RANK at least


def usable(vec: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, of unit norm."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng((seed, table)).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray, largest: float | np.ndarray, query: bool, more: int) -> np.ndarray:
    """Unit vectors of a power of two's length. Candidates are scaled by the largest norm (of their range) and topped up in
    one coordinate, if there is one more."""
    dim = x.shape[1]
    out = np.zeros((len(x), 1 << max(1, int(np.ceil(np.log2(dim + more))))))
    if query or not more:
        out[:, :dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        out[:, :dim] = x / largest
        out[:, dim] = np.sqrt(np.maximum(0.0, 1 - (out[:, :dim] ** 2).sum(1)))
    return out


def widths(n: int, size: int, probes: int) -> list[int]:
    """Axes of each hash of a table (of `size` dimensions): whole ones first, a part of one last."""
    left, out = max(2.0, n * probes / (ROWS * n**GROWTH)), []
    while left > 2 * size:
        out.append(size)
        left /= 2 * size
    return [*out, max(1, min(size, int(np.ceil(left / 2))))]


def hashes(u: np.ndarray, table: int, seed: int, cut: list[int]) -> list[np.ndarray]:
    """For each hash of a table the values of its signed axes."""
    turns = [turned(u, 16 * table + i, seed)[:, :w] for i, w in enumerate(cut)]
    return [np.concatenate([r, -r], 1) for r in turns]


def ranked_buckets(signed: list[np.ndarray], probes: int) -> np.ndarray:
    """The `probes` buckets (or all) with the largest sums of signed coordinates, of each row. A bucket is a number with a
    digit for each hash; the best sums only need the best digits, so a beam of `probes` is exact."""
    total, code = np.zeros((len(signed[0]), 1)), np.zeros((len(signed[0]), 1), np.int64)
    for values in signed:
        m = min(probes, values.shape[1])
        best = np.argpartition(-values, m - 1, axis=1)[:, :m]
        sums = (total[:, :, None] + np.take_along_axis(values, best, 1)[:, None, :]).reshape(len(values), -1)
        codes = (code[:, :, None] * values.shape[1] + best[:, None, :]).reshape(len(values), -1)
        keep = np.argpartition(-sums, min(probes, sums.shape[1]) - 1, axis=1)[:, :probes]
        total, code = np.take_along_axis(sums, keep, 1), np.take_along_axis(codes, keep, 1)
    return code


def neighbours(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec: str = "embedding", k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, tile_candidates: int = TILE_CANDIDATES, tile_queries: int = TILE_QUERIES, scored: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first, ties to the smaller id. `scored` counts
    the pairs that are compared."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable("vec") & F.col("vec_id").isNotNull())
    spark, scratch = vectors.sparkSession, base.Scratch(vectors.sparkSession)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(norm).alias("largest"), F.min(norm).alias("smallest"), F.count("*").alias("n")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not facts.n:
        return spark.createDataFrame([], out)
    total, dim, largest = facts.n, facts.dim, facts.largest * (1 + 1e-12)
    range_of = F.greatest(F.lit(0), F.floor(2 * F.log2(F.lit(largest) / norm))).cast("int") if facts.smallest < facts.largest * (1 - 1e-6) else F.lit(0)
    rows = rows.withColumn("level", range_of)
    tops = {r.level: (r.top * (1 + 1e-12), r.low) for r in rows.groupBy("level").agg(F.max(norm).alias("top"), F.min(norm).alias("low")).collect()}  # a row for each root of two between the norms
    more = int(any(low < top * (1 - 1e-6) for top, low in tops.values()))
    cut = widths(total, unit(np.ones((1, dim)), 1.0, True, more).shape[1], probes)
    base_digits = 2 * cut[-1]  # the last hash: candidates and queries meet by the others, and are told apart by it inside
    equal = W.partitionBy("vec").orderBy("vec_id")  # of equal vectors the first k + 1 ids are enough; a repeated row is one candidate
    ranked = rows.withColumn("copy", F.dense_rank().over(equal)).withColumn("again", F.lag("vec_id").over(equal).eqNullSafe(F.col("vec_id"))).filter((F.col("copy") <= k + 1) & ~F.col("again"))
    chosen = base.hash_sample(rows, "vec_id", base.sample_fraction(facts.n, SAMPLE)).select("vec_id", "vec").toPandas()  # bounded by SAMPLE
    sample = spark.sparkContext.broadcast((chosen.vec_id.to_numpy(), matrix(chosen.vec, dim)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf.vec, dim)
            level = pdf.level.to_numpy()
            u = unit(x, np.array([tops[v][0] for v in level.tolist()]).reshape(-1, 1), False, more)
            raw = [v.tobytes() for v in x]
            for t in range(tables):
                code = ranked_buckets(hashes(u, t, seed, cut), 1)[:, 0]
                yield pd.DataFrame({"tab": np.full(len(x), t, np.int32), "level": level, "bucket": code // base_digits, "sub": (code % base_digits).astype(np.int32), "vec_id": pdf.vec_id, "vec": raw})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, some = sample.value
        for pdf in batches:
            for i in range(0, len(pdf), 1_000):
                part = pdf.iloc[i : i + 1_000]
                x, own = matrix(part.vec, dim), part.vec_id.to_numpy()
                s = np.where(own[:, None] == ids[None, :], -np.inf, x @ some.T)
                low = max(FLOOR_RANK, int(np.ceil(FLOOR_SHARE * k * len(ids) / total)))
                floor = np.partition(s, s.shape[1] - low, axis=1)[:, s.shape[1] - low] if s.shape[1] > low else np.full(len(x), -np.inf)
                u, raw = unit(x, largest, True, more), [v.tobytes() for v in x]
                for t in range(tables):
                    code = np.sort(ranked_buckets(hashes(u, t, seed, cut), probes), axis=1)
                    group, sub = code // base_digits, code % base_digits
                    new = np.ones(code.shape, bool)
                    new[:, 1:] = group[:, 1:] != group[:, :-1]
                    row, at = np.nonzero(new)
                    ends = np.append(np.flatnonzero(new.ravel())[1:], new.size)
                    subs = [v.astype(np.int32) for v in np.split(sub.ravel(), ends[:-1])]
                    yield pd.DataFrame({"tab": np.full(len(row), t, np.int32), "bucket": group[row, at], "subs": subs, "query_id": own[row], "query": [raw[r] for r in row], "floor": floor[row]})

    stored = scratch(ranked.select("vec_id", "vec", "level").mapInPandas(index, "tab int, level int, bucket long, sub int, vec_id long, vec binary"), "ann_index")
    asked = scratch(rows.filter("asks").select("vec_id", "vec").mapInPandas(ask, "tab int, bucket long, subs array<int>, query_id long, query binary, floor double"), "ann_queries")
    # candidates and queries of a bucket are dealt over tiles; sizes is joined by the bucket itself, as both sides are
    sizes = stored.groupBy("tab", "level", "bucket").agg(F.ceil(F.count("*") / tile_candidates).cast("int").alias("nc")).join(asked.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / tile_queries).cast("int").alias("nq")), ["tab", "bucket"])
    left = stored.join(sizes, ["tab", "level", "bucket"]).select("tab", "level", "bucket", F.pmod(F.xxhash64("vec_id"), "nc").cast("int").alias("tc"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("tq"), "sub", "vec_id", "vec")
    right = asked.join(sizes, ["tab", "bucket"]).select("tab", F.col("level").alias("level"), "bucket", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("tc"), F.pmod(F.xxhash64("query_id"), "nq").cast("int").alias("tq"), "subs", "query_id", "query", "floor")

    def rank(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(found) or not len(queries):
            return none
        found = found.sort_values("sub", kind="stable")
        sub = found["sub"].to_numpy()
        c, ids = np.frombuffer(b"".join(found.vec), np.float64).reshape(len(found), -1), found.vec_id.to_numpy()
        x, own = np.frombuffer(b"".join(queries["query"]), np.float64).reshape(len(queries), -1), queries.query_id.to_numpy()
        floor, n_subs = queries.floor.to_numpy(), queries.subs.map(len).to_numpy()
        wanted, who = np.concatenate(queries.subs.to_list()), np.repeat(np.arange(len(queries)), n_subs)
        parts = []
        for bucket in np.unique(sub).tolist():
            i, j = np.searchsorted(sub, [bucket, bucket + 1])
            asking = who[wanted == bucket]
            most = k + (j - i) - len(np.unique(ids[i:j]))  # rows among which k ids are, if an id has several vectors
            for b in range(0, len(asking), 500):
                at = asking[b : b + 500]
                s = x[at] @ c[i:j].T
                if scored is not None:
                    scored.add(s.size)
                s = np.where(own[at][:, None] == ids[None, i:j], -np.inf, s)
                low = floor[at]
                if s.shape[1] > most:
                    low = np.maximum(low, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
                low = np.maximum(low, -1e300)
                p, q = np.nonzero(s >= (low - 1e-9 * np.minimum(1 + np.abs(low), 1e300))[:, None])
                parts.append((own[at[p]], ids[i + q], np.einsum("ij,ij->i", x[at[p]], c[i + q])))
        if not parts:
            return none
        query, vec_id, score = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((-score, vec_id, query))  # of an id with several vectors the nearest
        query, vec_id, score = query[order], vec_id[order], score[order]
        once = np.append(True, (query[1:] != query[:-1]) | (vec_id[1:] != vec_id[:-1])) if len(query) else np.zeros(0, bool)
        query, vec_id, score = query[once], vec_id[once], score[once]
        order = np.lexsort((vec_id, -score, query))  # a tile's first k of a query are enough
        query, vec_id, score = query[order], vec_id[order], score[order]
        first = np.append(True, query[1:] != query[:-1]) if len(query) else np.zeros(0, bool)
        nth = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.zeros(0, int)
        return pd.DataFrame({"query_id": query, "vec_id": vec_id, "score": score})[nth < 2 * k]

    def first(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
        best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = scratch(first(left, right, ["tab", "level", "bucket", "tc", "tq"]), "ann_found")
    full = found.groupBy("query_id").agg(F.count("*").alias("held")).filter(F.col("held") >= k).select("query_id")
    short = scratch(asked.filter("tab = 0").select("query_id", "query").distinct().join(full, "query_id", "left_anti"), "ann_short")
    nq = -(-short.count() // tile_queries)
    if not nq:
        scratch.drop(stored, asked, short)
        return found
    all_rows = stored.filter("tab = 0")
    nc = -(-all_rows.count() // tile_candidates)
    left = all_rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(nc)).cast("int").alias("tc"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("tq"), F.lit(0).alias("sub"), "vec_id", "vec")
    right = short.select(F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("tc"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("tq"), F.array(F.lit(0)).alias("subs"), "query_id", "query", F.lit(float("-inf")).alias("floor"))
    return scratch.last(found.join(full, "query_id", "left_semi").unionByName(first(left, right, ["tc", "tq"])), "ann_full")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE_SQL: dict[str, str] = {}
