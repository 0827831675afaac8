"""Alignment of two tokenizers' tokens over the same bytes.

Bitsets mark the bytes where a token of either side ends; their AND gives the shared cuts, and popcounts (rank) turn a cut into token
numbers of both sides. Between two shared cuts lies a group; each of its A tokens is linked with each of its B tokens. All texts of a block are
aligned at once: their bytes follow one another in one bitset, and a text's end is a cut of both sides.

Counts of id pairs are document counts over the corpus. A block of about BLOCK_CHARS characters holds a table of its distinct pairs;
tables are summed by pair, and each block gets back the sums of its own pairs, so no task sees the pairs of the whole corpus, nothing is broadcast,
and a frequent pair is one row a block. A document keeps its pairs as indices into its block's table with their multiplicities. Blocks are written to
the shared folder before they are counted; a lost executor's part is read again.

Rows with null or empty texts, and those where either side's bytes are not the space and the text, have no tokens: zeros. Special tokens' strings in
texts are plain text. Repeated rows are documents each. Of an A id's pairs with equal counts all are best. A very long text is a block
of its own, in memory proportional to its bytes and links; within a group links are counted by distinct ids, never listed. An empty table gives no
rows. Only the text is read and the columns to keep are passed on; others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import base, packing

BLOCK_CHARS = 4_000_000
GAP = "▁"  #: stands for a space in pieces
NEW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Vocabulary:
    """Bytes of each id, one after another, and the ids as text with what may follow them."""

    def __init__(self, tokens: Sequence[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.after = {mark: np.array([b"%d%s" % (i, mark) for i in range(len(tokens))], object) for mark in (b",", b"|", b";")}

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of the ids."""
        size = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteBpe(Vocabulary):
    """The byte-level BPE of packing; side A, which gets a space before the text."""

    def __init__(self, ranks: str | None = None, exact: str | None = None):
        self.encode = packing.byte_bpe(ranks, exact, special=False)
        super().__init__(packing.byte_bpe_tokens(ranks))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(" " + t) for t in texts]


class Pieces(Vocabulary):
    """A piece model; side B, which adds the space itself."""

    def __init__(self, model: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(GAP, " ").encode() for i, p in enumerate(names)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def bitset(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Words of 64 bits in which bit e is set for each end e (1 to n_bytes)."""
    marks = np.zeros((n_bytes // 64 + 1) * 64, np.uint8)
    marks[ends] = 1
    return np.packbits(marks, bitorder="little").view("<u8")


def rank(bits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many bits are set up to each cut, itself included."""
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    word, place = cuts >> 6, (cuts & 63).astype(np.uint64)
    upto = bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - place))
    return before[word] + np.bitwise_count(upto)


@dataclass
class Aligned:
    """Texts over one run of bytes: tokens of both sides, and for each group where its tokens end on either side."""

    a: np.ndarray
    b: np.ndarray
    cuts: np.ndarray  # byte where each group ends
    a_end: np.ndarray
    b_end: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
        a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
        n = int(a_ends[-1]) if len(a_ends) else 0
        left, right = bitset(a_ends, n), bitset(b_ends, n)
        cuts = np.flatnonzero(np.unpackbits((left & right).view(np.uint8), bitorder="little"))
        return cls(a, b, cuts, rank(left, cuts), rank(right, cuts))

    def widths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)

    def text(self, va: Vocabulary, vb: Vocabulary) -> tuple[list[bytes], np.ndarray]:
        """Each id with the mark after it, in order of groups, and where groups end in that list."""
        wide_a, wide_b = self.widths()
        out = np.empty(len(self.a) + len(self.b), object)
        at = np.arange(len(self.a)) + np.repeat(self.b_end - wide_b, wide_a)
        out[at] = va.after[b","][self.a]
        out[at[self.a_end - 1]] = va.after[b"|"][self.a[self.a_end - 1]]
        at = np.arange(len(self.b)) + np.repeat(self.a_end, wide_b)
        out[at] = vb.after[b","][self.b]
        out[at[self.b_end - 1]] = vb.after[b";"][self.b[self.b_end - 1]]
        return out.tolist(), self.a_end + self.b_end

    def pairs(self, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair as a << 32 | b, how often): one entry a link, but in groups of more than `most` links one for each
        pair of ids."""
        wide_a, wide_b = self.widths()
        small = wide_a * wide_b <= most
        reps = np.where(small, wide_b, 0)
        each = np.repeat(reps, wide_a)  # links of each A token
        group = np.repeat(np.repeat(np.arange(len(self.cuts)), wide_a), each)
        first = np.repeat(np.repeat(self.b_end - wide_b, wide_a), each)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        found = [(group, np.repeat(self.a.astype(np.int64), each) << 32 | self.b[first + place], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(~small):
            ua, na = np.unique(self.a[self.a_end[g] - wide_a[g] : self.a_end[g]], return_counts=True)
            ub, nb = np.unique(self.b[self.b_end[g] - wide_b[g] : self.b_end[g]], return_counts=True)
            key = (ua.astype(np.int64)[:, None] << 32 | ub[None, :]).ravel()
            found.append((np.full(len(key), g), key, (na[:, None] * nb[None, :]).ravel()))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values in a sorted array begins."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs: the width, then the numbers."""
    kind = np.min_scalar_type(x.max() if len(x) else 0)
    return b"%d" % kind.itemsize + x.astype(kind.newbyteorder("<")).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1).astype(np.int64)


def align(texts: list[str], va: ByteBpe, vb: Pieces) -> tuple[list[tuple], np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """A block of texts: for each its digest (n_a, n_b, n_groups, n_links, groups_sha256); the block's pairs in order and in how many texts
    each stands; and for each text the steps between its pairs' indices and the pairs' multiplicities."""
    digests, held = [(0, 0, 0, 0, "")] * len(texts), [(b"", b"")] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    own = [(i, *ids) for i, *ids in zip(full, va.ids([texts[i] for i in full]), vb.ids([texts[i] for i in full]), strict=True)]
    kept = []
    for i, a, b in own:
        want = np.frombuffer(b" " + texts[i].encode(), np.uint8)
        if va.size[a].sum() == vb.size[b].sum() == len(want) and np.array_equal(va.spell(a), want) and np.array_equal(vb.spell(b), want):
            kept.append((i, a, b, len(want)))
    if not kept:
        return digests, np.zeros(0, np.int64), np.zeros(0, np.int64), held
    a, b = np.concatenate([x[1] for x in kept]).astype(np.int64), np.concatenate([x[2] for x in kept]).astype(np.int64)
    lined = Aligned.of(a, b, va.size[a], vb.size[b])
    ends = np.searchsorted(lined.cuts, np.cumsum([x[3] for x in kept])) + 1  # groups up to each text's end
    parts, part_ends = lined.text(va, vb)
    wide_a, wide_b = lined.widths()
    links = np.r_[0, np.cumsum(wide_a * wide_b)]
    group, key, times = lined.pairs()
    table, index = np.unique(key, return_inverse=True)
    owner = np.searchsorted(ends, group, side="right")
    both = owner.astype(np.int64) << 32 | index
    order = np.argsort(both, kind="stable")
    both, times = both[order], times[order]
    runs = _runs(both)
    both, times = both[runs], np.add.reduceat(times, runs)
    index = both & 0xFFFFFFFF
    bounds = np.searchsorted(both, np.arange(len(kept) + 1, dtype=np.int64) << 32)
    last = 0
    for k, (i, own_a, own_b, _) in enumerate(kept):
        end = int(ends[k])
        said = b"".join(parts[part_ends[last - 1] if last else 0 : part_ends[end - 1]])[:-1]
        digests[i] = (len(own_a), len(own_b), end - last, int(links[end] - links[last]), hashlib.sha256(said).hexdigest())
        here = slice(bounds[k], bounds[k + 1])
        held[i] = (_narrow(np.diff(index[here], prepend=0)), _narrow(times[here]))
        last = end
    return digests, table, np.bincount(index, minlength=len(table)), held


def pair_counts(tables: DataFrame) -> DataFrame:
    """(block, pair, count, best): tables (block, pair, texts) with each pair's texts in the corpus and whether that is the
    highest of its A id."""
    count = tables.groupBy("pair").agg(F.sum("texts").alias("count")).withColumn("a", F.shiftright("pair", 32))
    top = count.groupBy("a").agg(F.max("count").alias("top"))
    count = count.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    return tables.select("block", "pair").join(count, "pair").select("block", "pair", "count", "best")


def linked(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, exact: str | None = None, model: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`keep` columns of each row, its tokens on both sides (n_a, n_b), groups, links and the digest of its groups, how many links are
    their A id's best (n_best), and the sum of its links' counts (count_sum)."""
    scratch = base.Scratch(docs.sparkSession)
    base.small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    fields = [*rows.schema.fields[1:], *StructType.fromDDL(NEW).fields]
    schema = StructType([*fields, *StructType.fromDDL("block long, pairs binary, times binary, keys binary, texts binary").fields])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb, block = ByteBpe(ranks, exact), Pieces(model), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            texts = [t or "" for b in held for t in b.column(0).to_pylist()]
            digests, table, n, pairs = align(texts, va, vb)
            at = 0
            for b in held:
                here = range(at, at + b.num_rows)
                # The block's table travels with its first row.
                columns = [*zip(*(digests[i] for i in here), strict=True), [block] * b.num_rows, *zip(*(pairs[i] for i in here), strict=True), [None if i else table.astype("<i8").tobytes() for i in here], [None if i else n.astype("<i8").tobytes() for i in here]]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)
                at += b.num_rows

        for b in base.slices(batches, 100):
            first = 0
            for i, t in enumerate(b.column(0).to_pylist()):
                size += len(t or "")
                if size >= block_chars:
                    held.append(b.slice(first, i + 1 - first))
                    yield from made()
                    held, size, block, first = [], 0, block + 1, i + 1
            if first < b.num_rows:
                held.append(b.slice(first))
        if held:
            yield from made()

    blocks = scratch(rows.mapInArrow(run, schema), "blocks")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, n = np.frombuffer(keys, "<i8"), np.frombuffer(texts, "<i8")
                for i in range(0, len(key), 100_000):
                    part = key[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[i : i + 100_000])], names=["block", "pair", "texts"])

    tables = blocks.filter("keys is not null").select("block", "keys", "texts").mapInArrow(unpacked, "block long, pair long, texts long")
    counts = pair_counts(tables)
    out = StructType([*fields, *StructType.fromDDL("n_best long, count_sum long").fields])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        sums = []
        for pairs, times in zip(left["pairs"].to_pylist(), left["times"].to_pylist(), strict=True):
            i, n = np.cumsum(_wide(pairs)), _wide(times)
            sums.append((int((best[i] * n).sum()), int((count[i] * n).sum())))
        new = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] or [pa.array([], pa.int64())] * 2
        done = left.select(out.names[:-2])
        return done.append_column("n_best", new[0]).append_column("count_sum", new[1])

    own = blocks.filter("n_links > 0").select(*out.names[:-2], "block", "pairs", "times")
    some = own.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(summed, out)
    return some.union(blocks.filter("n_links = 0").select(*out.names[:-2], F.lit(0).cast("long"), F.lit(0).cast("long")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(base.table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
