"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is its words (runs of ASCII letters and digits and of all non-ASCII characters, ASCII in lower case); a shingle is
five words in a row, a shorter text is one shingle. A shingle weighs its count in the text times the mean inverse document
frequency of its words, 1 + ln((N + 1) / (df + 1)) / ln(N + 2): 1 for a word of all rows, 2 for a unique one. The bound
keeps a large group of copies, which makes its own words common, from counting an edit many times over. Document
frequencies count all rows, in a table of fixed size that words are hashed into.
Two texts are near-duplicates if their weighted Jaccard similarity, sum of minima over sum of maxima, is at least 0.8.

Consistent weighted samples (BANDS x ROWS) bring candidates together. Texts with the same words are one node. Within a
bucket all nodes are compared with its first one; where that does not connect a bucket, its nodes outside the largest
component are compared with all its nodes, tile by tile. So every candidate pair is verified unless links already connect
it, and no list of all pairs is ever made. Classes are the connected components of the links.

Texts without words (or null) are classes of their own. Repeated rows share a class. An empty table gives no rows. A very
long text costs time in proportion to its length. Ties: of equal ids in a class the row with the smallest hash of id and
text, then of all columns, is kept; similarities of exactly 0.8 count as near. Only the named columns are read for classes, and columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .licences import hash_words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
BUCKETS = 1 << 18  #: of the table of document frequencies
BLOCK = 1 << 15
TILE_MINOR, TILE_ALL = 250_000, 400_000  #: shingles of a tile's rows outside the largest component, and of all its rows
SALTS = 16  #: parts over which the rows of one bucket or class are dealt in joins
_U16 = 1 << 16


def _gamma_quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the midpoints of 2^16 equal shares, by Newton steps on 1 - (1 + x) exp(-x)."""
    p = (np.arange(_U16) + 0.5) / _U16
    x = np.where(p < 0.5, np.sqrt(2 * p), -np.log1p(-p) + 1.5)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12) * 0.9, 1e-6)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_R, _LOG_C = _gamma_quantiles()
_SEEDS = np.random.default_rng(99).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the number of words of each."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    first, hashes = hash_words(b"\n".join(coded))
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


@dataclass
class Shingles:
    """Distinct shingles of some texts, text by text: a 44-bit hash, the weight; shingles of each text; hash of its words."""

    key: np.ndarray
    weight: np.ndarray
    sizes: np.ndarray
    node: np.ndarray


def shingles(texts: list[str], idf: np.ndarray) -> Shingles:
    h, n = words(texts)
    start = np.cumsum(n) - n
    place = np.arange(len(h)) - np.repeat(start, n)
    node = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(h):
        node[some] = mixed(np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), start[some]))
    value = idf[(h >> np.uint64(46)).astype(np.int64)]
    total = np.append(0.0, np.cumsum(value))
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    width = np.repeat(np.minimum(n, SHINGLE), made)
    doc = np.repeat(np.arange(len(texts)), made)
    at = np.repeat(start, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    code = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        here = np.minimum(at + k, len(h) - 1)
        code = mixed(code + np.where(k < width, h[here], np.uint64(k)))
    weight = (total[at + width] - total[at]) / width
    joint = (doc.astype(np.uint64) << np.uint64(44)) | (code >> np.uint64(20))
    order = np.argsort(joint)
    joint, weight = joint[order], weight[order]
    new = np.flatnonzero(np.append(True, joint[1:] != joint[:-1])) if len(joint) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(joint)))
    joint = joint[new]
    return Shingles(joint & np.uint64((1 << 44) - 1), weight[new] * count, np.bincount((joint >> np.uint64(44)).astype(np.int64), minlength=len(texts)), node)


def band_keys(s: Shingles) -> np.ndarray:
    """Improved consistent weighted sampling: for each text with words and band, a hash of the band's samples."""
    sizes = s.sizes[s.sizes > 0]
    out = np.zeros((len(sizes), BANDS), np.uint64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):  # some texts at a time, so that arrays stay in the processor's cache
        lo = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, lo + 40_000, side="right")))
        key, log_w = s.key[lo : ends[j - 1]], np.log(s.weight[lo : ends[j - 1]]).astype(np.float32)
        first, n = ends[i:j] - sizes[i:j] - lo, sizes[i:j]
        for k, seed in enumerate(_SEEDS):
            z = (key ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            r, log_c = _R[z >> np.uint64(48)], _LOG_C[(z >> np.uint64(32)) & np.uint64(0xFFFF)]
            beta = ((z >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
            t = np.floor(log_w / r + beta)
            log_a = log_c - r * (t - beta) - r
            low = np.minimum.reduceat(log_a, first)
            hit = np.flatnonzero(log_a == np.repeat(low, n))
            hit = hit[np.searchsorted(hit, first)]  # the first of equal minima
            sample = mixed(key[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(k))
            out[i:j, k // ROWS] = mixed(out[i:j, k // ROWS] + sample)
        i = j
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequencies of hashed words over all rows of docs (text), and the number of rows. What travels is
    a table of fixed size from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + BLOCK, np.int64)
        for batch in base.slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            total[BUCKETS] += len(texts)
            for i, j in base.blocks(texts):
                h, n = words(texts[i:j])
                doc = np.repeat(np.arange(j - i), n)
                pair = np.sort((doc << 18) | (h >> np.uint64(46)).astype(np.int64))
                pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
                total[:BUCKETS] += np.bincount(pair & (BUCKETS - 1), minlength=BUCKETS)
        for b in range(0, len(total), BLOCK):
            if total[b : b + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"key": ["all"], "block": pa.array([b // BLOCK], pa.int32()), "counts": [total[b : b + BLOCK].tobytes()]})

    total = np.zeros(BUCKETS + BLOCK, np.int64)
    for r in base.sum_blocks(docs.select("text").mapInArrow(run, "key string, block int, counts binary"), "key").collect():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    n = int(total[BUCKETS])
    return 1 + np.log((n + 1) / (total[:BUCKETS] + 1)) / np.log(n + 2), n


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets of (key, weight)."""
    (ka, wa), (kb, wb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = np.minimum(wa, np.where(kb[at] == ka, wb[at], 0.0)).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def weighted_sets(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for i, j in base.blocks(texts):
        s = shingles(texts[i:j], idf)
        cut = np.append(0, np.cumsum(s.sizes))
        out += [(s.key[a:b], s.weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def linked(sets: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, minor: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join groups: rows marked `minor` against all rows, as long as they are not yet connected."""
    root = {g: g for g in group.tolist()}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    column, where = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
    sizes = np.array([len(k) for k, _ in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    weight = np.concatenate([w for _, w in sets])
    total = np.array([w.sum() for _, w in sets])
    order = np.argsort(where, kind="stable")
    where, row, weight = where[order], row[order], weight[order]
    begin = np.searchsorted(where, np.arange(len(column) + 1))
    found = []
    for a in np.flatnonzero(minor).tolist():
        mine = np.searchsorted(column, sets[a][0])
        n = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(row[at], np.minimum(weight[at], np.repeat(sets[a][1], n)), minlength=len(sets))
        near = np.flatnonzero(both >= threshold * (total[a] + total - both) - 1e-9)
        for b in near.tolist():
            ga, gb = find(int(group[a])), find(int(group[b]))
            if ga != gb:
                root[max(ga, gb)] = min(ga, gb)
                found.append((a, b))
    return found


def signed(docs: DataFrame, idf: np.ndarray, id_col: str, text: str) -> DataFrame:
    """(doc_id, rid, key, size, node, bands) of each row: rid stands for the row's id and text, key for its text, size counts
    its shingles, node stands for its words (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(texts: list[str]) -> list[list]:
        nodes, sizes, bands = [], [], []
        for i, j in base.blocks(texts):
            s = shingles(texts[i:j], shared.value)
            keys = iter(band_keys(s).view(np.int64))
            nodes += [n if size else None for n, size in zip(s.node.view(np.int64).tolist(), s.sizes, strict=True)]
            bands += [next(keys) if size else None for size in s.sizes]
            sizes += s.sizes.tolist()
        return [nodes, sizes, bands]

    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(id_col, text).alias("rid"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return base.map_texts(rows, "text", ["doc_id", "rid", "key"], "node long, size long, bands array<long>", run)


def row_id(id_col: str, text: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("\0")))


def dealt_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their keys (one row each): the rows of a key are dealt over SALTS parts and its facts go to all of
    them, so that the rows of one key meet in no single task."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS)).cast("int"))
    return dealt.join(facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, rid, class_id) of each row; class_id is the smallest id of the class."""
    spark, scratch = docs.sparkSession, base.Scratch(docs.sparkSession)
    idf, _ = document_frequencies(docs.select(F.col(text).alias("text")))
    rows = scratch(signed(docs, idf, id_col, text), "signed")
    shared = spark.sparkContext.broadcast(idf)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    leads = members.groupBy("band", "bucket").agg(F.min("node").alias("lead"), F.count("*").alias("held")).filter("held > 1").drop("held")
    members = scratch(dealt_join(members, leads, ["band", "bucket"], "node"), "buckets")
    pairs = members.filter("node <> lead").select("node", "lead").distinct()
    busy = members.select("node").distinct()
    keys = nodes.select("node", "key").join(busy, "node")
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).join(keys, "key").groupBy("node").agg(F.first("text").alias("text"))
    texts = scratch(texts, "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in base.slices(batches, 300):
            node, lead, own, lead_text = (b.column(i).to_pylist() for i in range(4))
            for x, t in zip(lead, lead_text, strict=True):
                if x not in held:
                    held[x] = weighted_sets([t], shared.value)[0]
            near = [similarity(s, held[x]) >= threshold - 1e-9 for s, x in zip(weighted_sets(own, shared.value), lead, strict=True)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([v for v, ok in zip(node, near, strict=True) if ok], pa.int64()), "b": pa.array([v for v, ok in zip(lead, near, strict=True) if ok], pa.int64())})
            if len(held) > 300:
                held.clear()

    sided = pairs.join(texts, "node").join(texts.select(F.col("node").alias("lead"), F.col("text").alias("lead_text")), "lead")
    links = scratch(sided.select("node", "lead", "text", "lead_text").mapInArrow(verify, "a long, b long"), "links")
    groups = base.connected(links, scratch)

    # buckets that these links leave in parts
    members = members.select("band", "bucket", "node", "size").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = members.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    major = parts.groupBy("band", "bucket").agg(F.max(F.struct("n", "component", "size")).alias("m"), F.count("*").alias("parts"), F.sum("size").alias("held")).filter("parts > 1")
    major = major.select("band", "bucket", F.col("m.component").alias("major"), F.ceil(F.col("held") / TILE_ALL).cast("int").alias("ta"), F.ceil((F.col("held") - F.col("m.size")) / TILE_MINOR).cast("int").alias("tm"))
    open_ = dealt_join(members, major, ["band", "bucket"], "node")
    salt = lambda n, by: F.pmod(F.xxhash64(F.lit(by), "node"), F.col(n)).cast("int")
    every = open_.select("band", "bucket", "node", "component", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("tm") - 1)).alias("i"), salt("ta", "all").alias("j"))
    minor = open_.filter("component <> major").select("band", "bucket", "node", "component", F.lit(True).alias("minor"), salt("tm", "minor").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ta") - 1)).alias("j"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "minor"], ascending=[True, False]).drop_duplicates("node")
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if pdf.component.nunique() < 2:
            return none
        found = linked(weighted_sets(list(pdf.text), shared.value), pdf.component.to_numpy(), pdf.minor.to_numpy(bool), threshold)
        base.release()
        c = pdf.component.to_numpy()
        return pd.DataFrame({"a": c[[a for a, _ in found]], "b": c[[b for _, b in found]]}) if found else none

    more = every.union(minor).join(texts, "node").groupBy("band", "bucket", "i", "j").applyInPandas(tile, "a long, b long")
    over = base.connected(scratch(more.distinct(), "more_links"), scratch).select(F.col("node").alias("component"), F.col("component").alias("over"))
    whole = groups.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    single = over.join(groups, over.component == groups.node, "left_anti").select(F.col("component").alias("node"), F.col("over").alias("component"))
    found = whole.union(single)
    rows = rows.select("doc_id", "rid", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = scratch(rows.select("doc_id", "rid", "component"), "components")
    least = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).filter("class_size > 1")
    return scratch.last(dealt_join(rows, least, ["component"], "rid", "left").select("doc_id", "rid", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "component"), "classes")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one with the smallest id (then the smallest hash of id and text, then of all
    columns). Rows without words are classes of their own and stay, each of them."""
    found = classes(docs, id_col=id_col, text=text, threshold=threshold)
    keep = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select(F.col("m.rid").alias("rid"))
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))  # no name of docs can clash
    own = dict(zip(docs.columns, plain.columns, strict=True))
    worded = F.coalesce(F.col(own[text]).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    first = W.partitionBy("rid").orderBy(F.xxhash64(*plain.columns))  # rows that tie in this are equal
    kept = plain.filter(worded).withColumn("rid", row_id(own[id_col], own[text])).join(keep, "rid", "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return kept.select(*plain.columns).union(plain.filter(~worded)).toDF(*docs.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLE_SQL: dict[str, str] = {}
