"""Packing documents into fixed-length token sequences by Karmarkar-Karp multiway differencing.

Each document is its tokens and an end token. Whole windows are cut off first and fill a sequence each; what is left of
a document is one piece, and pieces are gathered into groups of about WINDOWS windows. Within a group the
differencing method merges the two partial partitions with the largest imbalance, largest sums against smallest, until one
partition with near-equal windows is left. If a window exceeds the capacity, the window count rises, by one
at a time and at most a RISE-th; if one still does, the longest piece of each such window is halved. So only documents that do not fit are cut.

Groups do not cross input partitions. What a partition has left beyond its last full group goes to a second step, in as many tasks as
the rest has groups, so that many small partitions do not leave many windows half empty. Pieces of the first step are written to the shared
folder before; a lost executor's partitions are packed alike again.
Null texts are empty: a lone end token. Repeated rows are packed each on its own; of pieces of equal length the earlier goes
first. A long text costs memory for its own tokens only. An empty table gives no rows. Only the text is read and the columns to
keep are passed on, which must not be named as the new ones; others may have any names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import base

CAPACITY = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"  #: the vocabulary's special token, its last id
WINDOWS = 96  #: windows of a group
RISE = 32  #: the window count rises by at most this part of itself before documents are cut
NAMES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"


def differencing(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Split items into k sets of near-equal sums: Karmarkar and Karp's method for k sets.

    A partial partition is its k sums, largest first, less their minimum, and for each set the node that holds its items:
    an item itself, or a pair of nodes that were merged. -1 is the empty set."""
    n = len(sizes)
    left, right = np.full(2 * n + k, -1, np.int64), np.full(2 * n + k, -1, np.int64)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-int(s), i, sums, nodes))
    heapq.heapify(heap)
    count, node = n, n
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums, other = a + b[::-1], other[::-1]
        both = np.flatnonzero((own >= 0) & (other >= 0))
        merged = np.maximum(own, other)
        fresh = np.arange(node, node + len(both))
        left[fresh], right[fresh], merged[both] = own[both], other[both], fresh
        node += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), count, sums, merged[order]))
        count += 1

    def items(top: int) -> list[int]:
        found, todo = [], [top]
        while todo:
            x = todo.pop()
            if x >= n:
                todo += (int(right[x]), int(left[x]))
            elif x >= 0:
                found.append(x)
        return found

    return [items(int(x)) for x in heap[0][3]] if heap else []


def windows(sizes: Sequence[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of at most `capacity`, as parts of items: (item, from, length). From the least number that can hold
    all, the window count rises by at most a RISE-th; after that the longest part of a window that exceeds the capacity is halved."""
    parts = [(i, 0, int(n)) for i, n in enumerate(sizes) if n]
    k = -(-sum(sizes) // capacity)
    most = k + max(1, k // RISE)
    while True:
        sets = [s for s in differencing([n for _, _, n in parts], k) if s]
        over = [s for s in sets if sum(parts[i][2] for i in s) > capacity]
        if not over:
            return [[parts[i] for i in s] for s in sets]
        if k < most:
            k += 1
            continue
        for s in over:
            i = max(s, key=lambda i: (parts[i][2], -i))
            item, at, n = parts[i]
            parts[i] = (item, at, n - n // 2)
            parts.append((item, at + n - n // 2, n // 2))


def byte_bpe_tokens(ranks: str | None = None) -> list[bytes]:
    """The bytes of each id of the vocabulary, its one special token last."""
    import public_tokenizers

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))] + [SPECIAL.encode()]


def byte_bpe(ranks: str | None = None, exact: str | None = None, *, special: bool = True) -> Callable[[str], np.ndarray]:
    """An encoder of a public byte-level BPE vocabulary. ranks: its ranks, for the quick library; exact: its definition,
    which encodes the texts that the quick one refuses. Both give the same ids. special: whether the special token's string in a text
    becomes its id, as the definition has it, or is plain text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokens = byte_bpe_tokens(ranks)
    quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[:-1])}, special_tokens={SPECIAL: len(tokens) - 1})
    allowed = {SPECIAL} if special else set()
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except BaseException as e:  # its panics are no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(exact or public_tokenizers.path("byte_bpe_50k.json")))
                slow[0].encode_special_tokens = not special
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class Packer:
    """Packs the documents of one partition; sequence numbers start from `first`. Rows that `rest` gives have no sequence yet."""

    def __init__(self, first: int, capacity: int, group: int):
        self.next, self.capacity, self.full = first, capacity, group * capacity
        self.pending: list[tuple[int, int, np.ndarray, int]] = []
        self.held = 0
        self.rows: list[tuple] = []

    def emit(self, row: int, start: int, ids: np.ndarray, total: int, seq: int | None, offset: int | None) -> None:
        self.rows.append((row, start, len(ids), ids.astype("<u4").tobytes(), total, seq, offset))

    def add(self, row: int, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.emit(row, at, ids[at : at + self.capacity], n, self.next, 0)
            self.next += 1
            at += self.capacity
        if at < n:
            self.hold(row, at, ids[at:], n)

    def hold(self, row: int, start: int, ids: np.ndarray, total: int) -> None:
        if self.held + len(ids) > self.full:
            self.flush()
        self.pending.append((row, start, ids, total))
        self.held += len(ids)

    def flush(self) -> None:
        for members in windows([len(p[2]) for p in self.pending], self.capacity):
            offset = 0
            for i, at, n in members:
                row, start, ids, total = self.pending[i]
                self.emit(row, start + at, ids[at : at + n], total, self.next, offset)
                offset += n
            self.next += 1
        self.pending, self.held = [], 0

    def rest(self) -> None:
        for row, start, ids, total in self.pending:
            self.emit(row, start, ids, total, None, None)
        self.pending, self.held = [], 0


class Kept:
    """The kept columns of the rows that a packer still holds pieces of, and the batches of pieces that are ready."""

    def __init__(self, packer: Packer):
        self.packer, self.number = packer, 0
        self.batches: dict[int, pa.RecordBatch] = {}  # by number of the first row

    def put(self, batch: pa.RecordBatch) -> None:
        self.batches[self.number] = batch

    def out(self) -> Iterator[pa.RecordBatch]:
        made, self.packer.rows = sorted(self.packer.rows, key=lambda r: r[0]), []
        at = 0
        for first in sorted(self.batches):
            end = at
            while end < len(made) and made[end][0] < first + self.batches[first].num_rows:
                end += 1
            if end > at:
                columns = list(zip(*made[at:end], strict=True))
                own = self.batches[first].take(pa.array([r - first for r in columns[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns[1:], TYPES, strict=True))], names=[*own.schema.names, *NAMES])
            at = end
        oldest = min((p[0] for p in self.packer.pending), default=self.number)
        for first in [f for f, b in self.batches.items() if f + b.num_rows <= min(oldest, self.number)]:
            del self.batches[first]


def pack(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = END_ID, group: int = WINDOWS, ranks: str | None = None, exact: str | None = None, ends: Column | None = None) -> DataFrame:
    """One row for each piece: `keep` columns, its start in the document, length, ids (little-endian unsigned 32-bit),
    the document's tokens, its sequence and its place there. `ends`: whether a row's text ends its document; those of
    which it is not true get no end token, and no row if they have no token at all."""
    scratch = base.Scratch(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), (F.lit(True) if ends is None else F.coalesce(ends, F.lit(False))).alias("_ends"), *keep)
    schema = StructType([*rows.schema.fields[2:], *StructType.fromDDL(SCHEMA)])
    base.small_batches(docs.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_bpe(ranks, exact), Packer(TaskContext.get().partitionId() << 36, capacity, group)
        kept = Kept(packer)
        for b in base.slices(batches):
            kept.put(b.select(list(range(2, b.num_columns))))
            size = 0
            for t, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t or "")
                packer.add(kept.number, np.append(ids, np.uint32(end_id)) if end else ids)
                kept.number += 1
                size += len(t or "")
                if size > base.BLOCK_CHARS:
                    yield from kept.out()
                    size = 0
            yield from kept.out()
        packer.rest()
        yield from kept.out()

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((1 << 62) + (TaskContext.get().partitionId() << 36), capacity, group)
        kept = Kept(packer)
        width = len(keep)
        for b in base.slices(batches):
            kept.put(b.select(list(range(width))))
            for start, ids, total in zip(*(b.column(width + i).to_pylist() for i in (0, 2, 3)), strict=True):
                packer.hold(kept.number, start, np.frombuffer(ids, "<u4"), total)
                kept.number += 1
            yield from kept.out()
        packer.flush()
        yield from kept.out()

    first = scratch(rows.mapInArrow(whole, schema), "pieces")
    rest = first.filter("sequence_id is null")
    tokens = rest.agg(F.sum("length")).first()[0]
    if not tokens:
        return first
    tasks, by = -(-tokens // (group * capacity)), F.xxhash64(*keep, "start", "ids")
    return first.filter("sequence_id is not null").union(rest.repartition(tasks, by).sortWithinPartitions("doc_tokens", "start", by).mapInArrow(left, schema))


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(base.table(spark, sf_dir, "documents")))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
