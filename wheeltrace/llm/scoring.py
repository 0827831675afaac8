"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Tokens are lower-cased words and an end of text. The model predicts a symbol from the vectors of the CONTEXT symbols before it:
one of the VOCABULARY most frequent words, the end, or, for any other word, one of KINDS kinds by last byte and length. Symbols
are dealt over classes of like frequency, and the model is normalised in two products of matrices: class after context, and symbol within class
after context. A kind's probability is shared among its words by their counts (0.5 for all unseen ones), so every token has a probability
and they add up to 1.

Training runs on the executors over every position of all training rows: each task starts from the same parameters and takes
noise-contrastive steps over its positions; the tasks' parameters are averaged, group by group, after each of ROUNDS rounds. A round takes
its share of each chunk's positions, so that each position is learned once.

Word counts are exact and cover all training rows: rows are read in chunks, each chunk's sorted distinct words travel in
ranges of the hash, to be added up, and only the sums travel back; no word list but the vocabulary is broadcast. A word in every
chunk is one entry a chunk. The base score is the unigram score with 0.5 added.

Null texts are empty: a lone end. Repeated rows count and are scored each on its own; equal texts get equal scores. Words that tie for the vocabulary go by
their hashes. Without training rows all tokens are
unknown and both scores are finite. An empty table gives no rows. A very long text makes a chunk of its own. Only doc_id, text and
held_out are read; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

VOCABULARY = 4_096
KINDS = 30
CLASSES = 64
CONTEXT, DIM, NOISE = 4, 24, 16
ROUNDS, BATCH, LEAST_BATCH, RATE = 2, 4_096, 512, 0.1
PIECE = 512  #: rows of one product of matrices, which BLAS does on one thread
GROUPS = 16  #: in which tasks' parameters are averaged before the driver gets them
END_HASH = np.uint64(0x2545F4914F6CDD1D)
CHUNK_CHARS = 4_000_000
BLOCK_CHARS = 1_000_000
RANGE_WORDS = 1_000_000  #: entries of one range of the hash
SCORED_TOKENS = 100_000  #: tokens whose probabilities are in memory at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.random.default_rng(8).integers(0, 1 << 63, (64, 256), dtype=np.uint64)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, an end after each text; and the tokens of each text."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    raw = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)]
    here = np.flatnonzero(~_SPACE[raw])
    start = np.ones(len(here), bool)
    start[1:] = np.diff(here) > 1
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(here)))
    place = np.arange(len(here)) - np.repeat(first, length)
    hashes = np.add.reduceat(_MIX[place & 63, raw[here]], first) if len(first) else np.zeros(0, np.uint64)
    kind = ((raw[here[first + length - 1]].astype(np.int64) * 7 + 3) % 10) * 3 + np.minimum(length // 4, 2) if len(first) else np.zeros(0, np.int64)
    words = np.diff(np.searchsorted(here[first], ends), prepend=0)
    at = np.cumsum(words)
    return np.insert(hashes, at, END_HASH), np.insert(kind, at, 0).astype(np.uint8), words + 1


def chunked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as chunks: sorted distinct words with their training counts and classes, and the texts
    as numbers of those words (low and high parts, which compress)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal k, size
            hashes, kinds, sizes = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            words, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            train = np.repeat(~np.concatenate([h[4] for h in held]), sizes)
            row = {
                "chunk": (part << 24) + k, "hashes": words.tobytes(), "counts": np.bincount(number[train], minlength=len(words)).astype(np.int64).tobytes(), "kinds": kinds[first].tobytes(),
                "low": (number & 0xFFFF).astype(np.uint16).tobytes(), "high": (number >> 16).astype(np.uint16).tobytes(), "sizes": sizes.astype(np.int64).tobytes(),
                "ids": np.concatenate([h[3] for h in held]).tobytes(), "no_id": np.concatenate([h[5] for h in held]).tobytes(), "held": np.concatenate([h[4] for h in held]).tobytes(),
            }
            held.clear()
            k, size = k + 1, 0
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int64() if n == "chunk" else pa.binary()) for n in row]))

        for b in base.slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, none, out_of = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False)
            for i, j in base.blocks(texts, BLOCK_CHARS):
                held.append((*token_hashes(texts[i:j]), ids[i:j], out_of[i:j], none[i:j]))
                size += sum(map(len, texts[i:j]))
                if size >= CHUNK_CHARS:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    return rows.mapInArrow(run, "chunk long, hashes binary, counts binary, kinds binary, low binary, high binary, sizes binary, ids binary, no_id binary, held binary")


def totals(chunks: DataFrame) -> DataFrame:
    """For each range of the hash and chunk: the training counts of the chunk's words over all chunks, in the order of the hashes;
    in the row of a range's first chunk also the sums of the range and its most frequent words."""
    entries = chunks.agg(F.sum(F.length("hashes"))).first()[0] or 0
    ranges = max(1, -(-entries // (8 * RANGE_WORDS)))
    bounds = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in base.released(batches):
            for r in pdf.itertuples():
                h, n, kind = np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.counts, np.int64), np.frombuffer(r.kinds, np.uint8)
                cut = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                made = [(i, r.chunk, h[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), kind[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pd.DataFrame(made, columns=["part", "chunk", "hashes", "counts", "kinds"])

    rows = chunks.select("chunk", "hashes", "counts", "kinds").mapInPandas(spread, "part int, chunk long, hashes binary, counts binary, kinds binary")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        held = [np.frombuffer(x, np.uint64) for x in pdf.hashes]
        sizes = [len(x) for x in held]
        words, first, number = np.unique(np.concatenate(held), return_index=True, return_inverse=True)
        total = np.bincount(number, np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.counts]), minlength=len(words)).astype(np.int64)
        kind = np.frombuffer(b"".join(pdf.kinds), np.uint8)[first]
        ends = words == END_HASH
        own = (total > 0) & ~ends
        most = np.flatnonzero(own)
        most = most[np.lexsort((words[most], -total[most]))[:VOCABULARY]]
        back = np.split(total[number], np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"part": pdf.part, "chunk": pdf.chunk, "totals": [x.tobytes() for x in back], "ends": 0})
        out["ends"] = [int(total[ends].sum()), *[0] * (len(pdf) - 1)]
        out["kind_n"] = [np.bincount(kind[own], total[own], minlength=KINDS).astype(np.int64).tolist(), *[None] * (len(pdf) - 1)]
        out["kind_v"] = [np.bincount(kind[own], minlength=KINDS).tolist(), *[None] * (len(pdf) - 1)]
        out["top"] = [[{"h": int(words[i].view(np.int64)), "n": int(total[i]), "kind": int(kind[i])} for i in most], *[None] * (len(pdf) - 1)]
        base.release()
        return out

    return rows.groupBy("part").applyInPandas(add, "part int, chunk long, totals binary, ends long, kind_n array<long>, kind_v array<long>, top array<struct<h:long,n:long,kind:int>>")


@dataclass
class Counts:
    """Training counts: all tokens, distinct tokens, the vocabulary with its counts (most frequent first), and each kind without it."""

    n: int
    v: int
    top: np.ndarray  # hashes
    top_n: np.ndarray
    kind_n: np.ndarray
    kind_v: np.ndarray
    ends: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.top)
        self.sorted = self.top[self.order]
        # symbols: 0..KINDS-1 kinds, KINDS the end, then the vocabulary; the start is a context only
        self.n_symbols = KINDS + 1 + len(self.top)
        self.counts = np.concatenate([self.kind_n, [self.ends], self.top_n]).astype(float) + 0.5
        rank = np.argsort(-self.counts, kind="stable")
        mass = np.cumsum(np.sqrt(self.counts[rank]))
        self.of = np.empty(self.n_symbols, np.int64)  # classes of like frequency and like sums of square roots
        self.of[rank] = np.minimum((mass - mass[0]) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        self.members = np.argsort(self.of, kind="stable")
        self.cut = np.searchsorted(self.of[self.members], np.arange(CLASSES + 1))
        # for draws: sums of the counts up to each member, and up to the start and the end of each class; and what noise weighs
        self.high_of = np.cumsum(self.counts[self.members])
        ends = np.append(0.0, self.high_of)[self.cut]
        self.low, self.high = ends[:-1], ends[1:]
        self.log_class = np.log(np.maximum((self.high - self.low) / self.high[-1], 1e-12) * NOISE).astype(np.float32)
        self.log_inside = np.log(self.counts / np.maximum((self.high - self.low)[self.of], 1e-12) * NOISE).astype(np.float32)

    def symbols(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = kinds.astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == hashes, KINDS + 1 + self.order[at], out)
        return np.where(hashes == END_HASH, KINDS, out)


def count(found: DataFrame) -> Counts:
    own = found.filter("top is not null")
    top = own.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "h").limit(VOCABULARY).collect()
    sums = own.select("ends", F.arrays_zip("kind_n", "kind_v").alias("c")).select("ends", F.posexplode("c").alias("kind", "c")).groupBy("kind").agg(F.sum("c.kind_n").alias("n"), F.sum("c.kind_v").alias("v"), F.sum("ends").alias("ends")).collect()
    kind_n, kind_v, ends = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64), 0
    for r in sums:
        kind_n[r.kind], kind_v[r.kind], ends = r.n, r.v, r.ends
    n, v = int(kind_n.sum()) + ends, int(kind_v.sum()) + (ends > 0)
    for r in top:
        kind_n[r.kind] -= r.n
        kind_v[r.kind] -= 1
    return Counts(n, v, np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64), kind_n, kind_v, ends)


def numbers(row) -> np.ndarray:
    return np.frombuffer(row.low, np.uint16).astype(np.int64) | (np.frombuffer(row.high, np.uint16).astype(np.int64) << 16)


def contexts(symbols: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT symbols before each token of texts that follow one another; `start` stands before a text."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(symbols), CONTEXT), start, symbols.dtype)
    for j in range(CONTEXT):
        out[j + 1 :, j] = np.where(place[j + 1 :] > j, symbols[: len(symbols) - j - 1], start)
    return out


def scatter(rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of `at` and the sums of their rows."""
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # two bytes are sorted by radix
    own = at[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


@dataclass
class LogBilinear:
    """score(class | context) and score(symbol | context, class) are products of the context's vector, the sum of its symbols'
    vectors weighed by place, with output vectors, and a bias."""

    params: list[np.ndarray]  # vectors, places, class output, class bias, symbol output, symbol bias

    @staticmethod
    def new(c: Counts, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        held = np.add.reduceat(c.counts[c.members], np.minimum(c.cut[:-1], c.n_symbols - 1)) * (np.diff(c.cut) > 0)
        share = np.log(np.maximum(held / c.counts.sum(), 1e-12))
        inside = np.log(c.counts / np.maximum(held[c.of], 1e-12))
        out = [rng.normal(0, 0.1, (c.n_symbols + 1, DIM)), np.tile(1 / np.arange(1, CONTEXT + 1)[:, None], (1, DIM)), np.zeros((CLASSES, DIM)), share, np.zeros((c.n_symbols, DIM)), inside]
        return LogBilinear([x.astype(np.float32) for x in out])

    def context(self, before: np.ndarray) -> np.ndarray:
        vectors, places = self.params[:2]
        return sum(np.take(vectors, before[:, j], axis=0) * places[j] for j in range(CONTEXT))

    def log10(self, c: Counts, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Normalised log10-probabilities of the symbols: two batched products of matrices, class and symbol within class."""
        x = self.context(before)
        _, _, class_out, class_bias, out, bias = self.params
        s = x @ class_out.T + class_bias
        s[:, np.diff(c.cut) == 0] = -np.inf
        kind = c.of[symbol]
        got = s[np.arange(len(s)), kind] - log_sum(s)
        order = np.argsort(kind, kind="stable")
        cut = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        place = np.empty(c.n_symbols, np.int64)
        place[c.members] = np.arange(c.n_symbols) - np.repeat(c.cut[:-1], np.diff(c.cut))
        for k in range(CLASSES):
            at, own = order[cut[k] : cut[k + 1]], c.members[c.cut[k] : c.cut[k + 1]]
            if len(at) and len(own) > 1:
                s = x[at] @ out[own].T + bias[own]
                got[at] += s[np.arange(len(at)), place[symbol[at]]] - log_sum(s)
        return got.astype(np.float64) / np.log(10)

    def learn(self, c: Counts, before: np.ndarray, symbol: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator) -> None:
        """Noise-contrastive steps on one batch: each symbol's class against classes, and the symbol against symbols of its
        class, drawn by their counts; steps are scaled by the sums of squared gradients. The rows of a batch share NOISE classes, and
        those of a class in it NOISE symbols, so their scores are products of matrices."""
        vectors, places, class_out, class_bias, out, bias = self.params
        order = np.argsort(c.of[symbol].astype(np.uint8), kind="stable")
        symbol, before = symbol[order], before[order]
        x, kind = self.context(before), c.of[symbol]
        live, first = np.unique(kind, return_index=True)
        cut = [*first.tolist(), len(kind)]
        pieces = lambda i, j: [slice(a, min(a + PIECE, j)) for a in range(i, j, PIECE)]
        noise_class = np.minimum(np.searchsorted(c.high, rng.random(NOISE) * c.high[-1], side="right"), CLASSES - 1)
        draw = c.low[live, None] + rng.random((len(live), NOISE)) * (c.high - c.low)[live, None]
        noise = c.members[np.minimum(np.searchsorted(c.high_of, draw, side="right"), c.cut[1:][live, None] - 1)]
        d_x = np.zeros_like(x)
        for weights, offsets, target, drawn, parts, w_at, b_at in (
            (class_out, class_bias - c.log_class, kind, noise_class[None], [(0, at) for at in pieces(0, len(x))], 2, 3),
            (out, bias - c.log_inside, symbol, noise, [(i, at) for i in range(len(live)) for at in pieces(cut[i], cut[i + 1])], 4, 5),
        ):
            w, w_noise, level = weights[target], weights[drawn], offsets[drawn]
            s = np.empty((len(x), NOISE + 1), np.float32)
            s[:, 0] = np.einsum("bd,bd->b", x, w) + offsets[target]
            for i, at in parts:
                s[at, 1:] = x[at] @ w_noise[i].T + level[i]
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            g[:, 0] -= 1
            d_x += g[:, :1] * w
            rows, sums = np.zeros((*drawn.shape, DIM), np.float32), np.zeros(drawn.shape, np.float32)
            for i, at in parts:
                own = g[at, 1:]
                d_x[at] += own @ w_noise[i]
                rows[i] += own.T @ x[at]
                sums[i] += own.sum(0)
            at, rows = scatter(np.concatenate([g[:, :1] * x, rows.reshape(-1, DIM)]), np.concatenate([target, drawn.ravel()]), len(weights))
            self.move(w_at, at, rows, squares)
            d_b = np.bincount(target, g[:, 0], minlength=len(offsets)) + np.bincount(drawn.ravel(), sums.ravel(), minlength=len(offsets))
            self.move(b_at, np.arange(len(offsets)), d_b.astype(np.float32), squares)
        d_places = np.stack([np.einsum("bd,bd->d", d_x, np.take(vectors, before[:, j], axis=0)) for j in range(CONTEXT)])
        at, rows = scatter((d_x[:, None, :] * places).reshape(-1, DIM), before.ravel(), len(vectors))
        self.move(0, at, rows, squares)
        self.move(1, np.arange(CONTEXT), d_places, squares)

    def move(self, which: int, at: np.ndarray, grad: np.ndarray, squares: list[np.ndarray]) -> None:
        squares[which][at] += grad * grad
        self.params[which][at] -= RATE * grad / np.sqrt(squares[which][at] + 1.0)


def log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return top + np.log(np.exp(s - top[:, None]).sum(1))


def batches_of(row, c: Counts, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The contexts and symbols of a chunk's training positions that are learned in this round, in random order: each position in one of
    the ROUNDS rounds. Small chunks make smaller batches, so that they too get some steps."""
    sizes, held = np.frombuffer(row.sizes, np.int64), np.frombuffer(row.held, bool)
    symbol = c.symbols(np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.kinds, np.uint8)).astype(np.int32)[numbers(row)]
    at = np.random.default_rng(row.chunk).permutation(np.flatnonzero(np.repeat(~held, sizes)))[turn::ROUNDS]
    before = contexts(symbol, sizes, c.n_symbols)
    size = min(BATCH, max(LEAST_BATCH, len(at) // 64))
    for i in range(0, len(at), size):
        yield before[at[i : i + size]], symbol[at[i : i + size]]


def train(chunks: DataFrame, c: Counts) -> LogBilinear:
    """Rounds of local steps on the executors and averages of what they learn."""
    spark, model = chunks.sparkSession, LogBilinear.new(c)
    if not c.n:
        return model
    first = max(GROUPS, math.isqrt(chunks.rdd.getNumPartitions()))  # tasks are averaged in as many groups as a group has tasks
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast((c, model))

        def learn(batches: Iterator[pd.DataFrame], now=now, turn=turn) -> Iterator[pd.DataFrame]:
            c, shared = now.value
            own = LogBilinear([p.copy() for p in shared.params])
            squares = [np.zeros_like(p) for p in own.params]
            seen = 0
            for pdf in base.released(batches):
                for r in pdf.itertuples():
                    rng = np.random.default_rng((turn, r.chunk))
                    for before, symbol in batches_of(r, c, turn):
                        own.learn(c, before, symbol, squares, rng)
                        seen += len(symbol)
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % first], "seen": [float(seen)], "params": [b"".join((p * seen).astype(np.float32).tobytes() for p in own.params)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, np.float32) for x in pdf.params], axis=0, dtype=np.float64)
            return pd.DataFrame({"part": pdf.part.iloc[:1], "seen": [pdf.seen.sum()], "params": [total.astype(np.float32).tobytes()]})

        schema = "part int, seen double, params binary"
        sums = chunks.select("chunk", "hashes", "kinds", "low", "high", "sizes", "held").mapInPandas(learn, schema).groupBy("part").applyInPandas(add, schema)
        sums = sums.withColumn("part", F.col("part") % GROUPS).groupBy("part").applyInPandas(add, schema).collect()  # GROUPS rows of the model's size
        flat = np.sum([np.frombuffer(r.params, np.float32) for r in sums], axis=0, dtype=np.float64) / sum(r.seen for r in sums)
        cut = np.cumsum([p.size for p in model.params])[:-1]
        model = LogBilinear([x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cut), model.params, strict=True)])
        now.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id (a whole number), text, held_out. Rows that are not held out are learned from; all are scored."""
    spark, scratch = docs.sparkSession, base.Scratch(docs.sparkSession)
    chunks = scratch(chunked(docs), "lm_chunks")
    found = scratch(totals(chunks), "lm_totals")
    counts = count(found)
    model = train(chunks, counts)
    shared = spark.sparkContext.broadcast((counts, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, m = shared.value
        inside = np.log10(c.kind_n + 0.5 * (c.kind_v + 1))
        for pdf in base.released(batches):
            for r in pdf.itertuples():
                hashes, kinds, sizes = np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.kinds, np.uint8), np.frombuffer(r.sizes, np.int64)
                total, number = np.frombuffer(b"".join(x["totals"] for x in r.found), np.int64), numbers(r)
                symbol = c.symbols(hashes, kinds)
                base_log = np.log10((total + 0.5) / (c.n + 0.5 * (c.v + 1)))
                own = np.where(symbol < KINDS, np.log10(total + 0.5) - inside[kinds], 0.0)
                first = np.cumsum(sizes) - sizes
                tokens = symbol[number]
                before = contexts(tokens, sizes, c.n_symbols)
                log_p = np.concatenate([m.log10(c, before[i : i + SCORED_TOKENS], tokens[i : i + SCORED_TOKENS]) for i in range(0, len(tokens), SCORED_TOKENS)]) + own[number]
                ids = pd.Series(np.frombuffer(r.ids, np.int64)).astype("Int64").mask(np.frombuffer(r.no_id, bool))
                yield pd.DataFrame({
                    "doc_id": ids, "held_out": np.frombuffer(r.held, bool), "n_tokens": sizes, "n_known": np.add.reduceat((total > 0)[number].astype(np.int64), first),
                    "train_tokens": np.full(len(sizes), c.n), "base_score": np.add.reduceat(base_log[number], first), "score": np.add.reduceat(log_p, first),
                })

    sums = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("found"))  # a chunk's ranges: no more than its words
    joined = chunks.drop("counts").join(sums, "chunk")
    return scratch.last(joined.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm_scores")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(base.table(spark, sf_dir, "documents").select("doc_id", "text", (base.fold("doc_id", 5) == 1).alias("held_out")))


QUERIES = {"op8_lm_scores": op8_lm_scores}
ORACLE_SQL: dict[str, str] = {}
