"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables, reranked by exact cosine.

A rotation is learned (on a bounded sample, all rows are indexed) that makes signs of the turned, centred unit vectors good
binary codes. Codes are cut into substrings; each is a table, and vectors of one label that agree in a table's
substring are compared by cosine on the original vectors, in double precision. A substring has about as many bits as the
logarithm of the rows of the largest label, so that buckets do not grow with the rows, and work stays nearly in proportion. Links are cosines about the origin and codes
signs about the mean, so how often a link at the threshold meets depends on the data: it is measured on pairs made from the
sample, and further rotations add tables until RECALL of them meet. Where MAX_TABLES don't do, substrings get shorter; at
none, all pairs of a label are compared. A pair counts in the first table where it
meets, so links are counted once and no list of pairs is ever written: groups send each vector's number of links and its
smallest linked vector.

Identical vectors of a label are one node with a number of copies. Buckets beyond TILE nodes are dealt over tiles that
meet pair by pair. Links at the threshold are thus found with a probability of about RECALL, closer ones with more. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing and are kept.
Shorter vectors count as padded with zeros. Repeated rows count as other vectors and share their component; of ties the smallest id gives the component its name. An empty
table gives no rows. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .neighbours import matrix, usable

THRESHOLD = 0.93
BUCKET_ROWS = 16  #: rows of a bucket that the substrings' length aims at
MIN_BITS, MAX_BITS = 4, 30  #: of a substring
MAX_TABLES = 64
RECALL = 0.98  #: of pairs at the threshold
TILE = 2_000
SAMPLE = 10_000  #: bound of the sample that the rotation is learned on


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 25, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits): principal components, then alternating codes and orthogonal Procrustes."""
    mean = x.mean(0)
    _, vec = np.linalg.eigh((x - mean).T @ (x - mean))
    pca = vec[:, ::-1][:, :bits]
    v = (x - mean) @ pca
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        code = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(code.T @ v)
        turn = (a @ b).T
    return mean, pca @ turn


def threshold_pairs(x: np.ndarray, threshold: float, n: int = 4_000, seed: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the threshold: rows of x moved in any direction, rows moved towards others, and, where x has
    enough of them, linked rows near the threshold."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), n)]
    out = []
    for w in (rng.normal(size=a.shape), x[rng.integers(0, len(x), n)]):
        w = w - (w * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(w, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if some.any():
            out.append((a[some], threshold * a[some] + np.sqrt(1 - threshold**2) * w[some] / size[some]))
    few = x[:3_000]
    s = few @ few.T
    p, q = np.nonzero(np.triu((s >= threshold) & (s < threshold + (1 - threshold) / 3), 1))
    if len(p) >= 200:
        pick = rng.permutation(len(p))[:n]
        out.append((few[p[pick]], few[q[pick]]))
    return out


def choose_tables(x: np.ndarray, threshold: float, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """Rotations (mean and projection), bits of a substring and number of tables that let RECALL of the pairs at the
    threshold meet, from `bits` downwards; no bits and one table where no tables do."""
    dim, pairs = x.shape[1], threshold_pairs(x, threshold)
    for bits in range(min(bits, dim), 0, -1):  # noqa: PLR1704
        per, learned, tables = max(1, dim // bits), [], 0
        met = [np.zeros(len(a), bool) for a, _ in pairs]
        while tables < MAX_TABLES:
            mean, turn = learn_rotation(x, per * bits, seed=len(learned) + 1)
            learned.append((mean, turn))
            same = [((a - mean) @ turn >= 0) == ((b - mean) @ turn >= 0) for a, b in pairs]
            for t in range(per):
                tables += 1
                met = [m | s[:, t * bits : (t + 1) * bits].all(1) for m, s in zip(met, same, strict=True)]
                if all(m.mean() >= RECALL for m in met):
                    return learned, bits, tables
            if min(m.mean() for m in met) < RECALL * tables / MAX_TABLES / 2:
                break  # hopeless at this length
    return [], 0, 1


def compare(x: np.ndarray, codes: np.ndarray, tile: np.ndarray, table: int, cross: bool, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by copies) of each row that count in this table, and each row's smallest linked row in the group."""
    n = len(x)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, root = np.zeros(n, np.int64), np.arange(n)
    a, b = (np.flatnonzero(tile == tile.min()), np.flatnonzero(tile != tile.min())) if cross else (np.arange(n), np.arange(n))
    adj = np.zeros((n, n), bool)
    for i in range(0, len(a), 500):
        at = a[i : i + 500]
        near = (x[at] @ x[b].T) / (norm[at][:, None] * norm[b][None, :]) >= threshold
        p, q = np.nonzero(near)
        p, q = at[p], b[q]
        keep = p != q
        p, q = p[keep], q[keep]
        first = (codes[p][:, :table] != codes[q][:, :table]).all(1)  # they meet in no table before
        adj[p[first], q[first]] = True
    if cross:
        adj |= adj.T
    links += adj @ copies
    while True:
        low = np.where(adj, root[None, :], n).min(1, initial=n)
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, root
        root = new


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile_rows: int = TILE, scored: Accumulator | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row. `scored` counts the pairs that are compared."""
    spark, scratch = vectors.sparkSession, base.Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    rows = rows.withColumn("node", F.when(usable("vec") & F.col("label").isNotNull(), F.xxhash64("label", "vec")))
    nodes = scratch(rows.filter("node is not null").groupBy("node", "label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "nodes")
    facts = nodes.groupBy("label").agg(F.max(F.size("vec")).alias("dim"), F.count("*").alias("n")).agg(F.max("dim").alias("dim"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not facts.n:
        return alone
    dim = facts.dim
    fit = base.hash_sample(nodes, "node", base.sample_fraction(facts.n, SAMPLE)).select("vec").toPandas()  # bounded by SAMPLE
    wanted = int(np.clip(np.ceil(np.log2(max(facts.most / BUCKET_ROWS, 1))), MIN_BITS, MAX_BITS))
    turns, bits, tables = choose_tables(unit_rows(matrix(fit.vec, dim)) if len(fit) else np.eye(dim), threshold, wanted)
    learned = spark.sparkContext.broadcast(turns)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf.vec, dim)
            u, codes = unit_rows(x), np.zeros((len(x), tables), np.int32)
            if bits:
                signs = [(u - mean) @ turn >= 0 for mean, turn in learned.value]
                cut = [s[:, i : i + bits] for s in signs for i in range(0, s.shape[1], bits)]
                codes = np.stack([c @ (1 << np.arange(bits)) for c in cut[:tables]], 1).astype(np.int32)
            raw, code = [v.tobytes() for v in x], [c.tobytes() for c in codes]
            for t in range(tables):
                yield pd.DataFrame({"tab": np.full(len(x), t, np.int32), "bucket": codes[:, t], "label": pdf.label, "node": pdf.node, "copies": pdf.copies, "vec": raw, "code": code})

    kind = nodes.schema["label"].dataType.simpleString()
    schema = f"tab int, bucket int, label {kind}, node long, copies long, vec binary, code binary"
    stored = scratch(nodes.select("label", "node", "copies", "vec").mapInPandas(index, schema), "codes")
    key = F.xxhash64("label", "bucket")
    sizes = stored.groupBy("tab", "label", "bucket").agg(F.count("*").alias("held")).filter("held > 1").select("tab", "label", "bucket", F.ceil(F.col("held") / tile_rows).cast("int").alias("tiles"))
    dealt = stored.join(sizes, ["tab", "label", "bucket"]).withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).withColumn("key", key)
    parts = -(-facts.n // tile_rows)  # small buckets travel together, about tile_rows rows at a time
    dealt = dealt.withColumn("part", F.when(F.col("tiles") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(parts))))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = np.frombuffer(b"".join(pdf.vec), np.float64).reshape(len(pdf), -1)
        codes = np.frombuffer(b"".join(pdf.code), np.int32).reshape(len(pdf), -1)
        own, tile, copies, node = pdf.key.to_numpy(), pdf.tile.to_numpy(), pdf.copies.to_numpy(), pdf.node.to_numpy()
        table, cross = int(pdf["tab"].iloc[0]), bool(pdf.ta.iloc[0] != pdf.tb.iloc[0])
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out = []
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(own)], strict=True):
            found, root = compare(x[i:j], codes[i:j], tile[i:j], table, cross, copies[i:j], threshold)
            some = np.flatnonzero(found > 0)
            if len(some):
                out.append((node[i + some], found[some], node[i + root[some]]))
            if scored is not None:
                scored.add((j - i) * (j - i - 1) // 2)
        a, n, b = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"a": a, "links": n, "b": b})

    found = scratch(dealt.select("tab", "part", "ta", "tb", "key", "tile", "node", "copies", "vec", "code").groupBy("tab", "part", "ta", "tb").applyInPandas(links, "a long, links long, b long"), "links")
    groups = base.connected(found.select("a", "b"), scratch)
    count = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    info = nodes.select("node", "copies", "least").join(count, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(info, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.last(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vector_classes")


def op9_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_vector_duplicates": op9_vector_duplicates}
ORACLE_SQL: dict[str, str] = {}
