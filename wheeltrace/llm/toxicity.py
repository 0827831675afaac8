"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel compares two windows of text by the subsequences of four characters that they share; one that spreads over
c + 1 places weighs DECAY ** (c + 1), at most SPAN places (a window's start or end is a character too). Insults with inserted or missing
characters keep most of their subsequences. A window is a token, two neighbouring tokens joined, or a run of
single characters; punctuation inside a token is dropped first. So `i.d.i-o.t`, `id iot` and `i d i o t` read as one word.

Labels mark whole texts (sentences or longer), so training has several instances to a label. At first every token counts
for both labels, by its texts of each; then the windows of toxic texts that the machine puts above 0 are their witnesses and train against
all tokens of clean texts and the highest window of each clean text, in rounds. Executors hold the instances and send the sums of the Newton steps; the
driver only ever solves systems of LANDMARKS + 1 unknowns. As the decision is linear in the landmarks, they
fold into one weight for each (hashed) subsequence, which is the machine's exact value; sums of these weights along a text then give
the value of any window. A text's score is a logistic of its highest window value and its number of windows above 0, against its length.

Training uses a hash sample of about POSITIVE_DOCS toxic and NEGATIVE_DOCS clean labelled rows at most; all their tokens
are used. Null and empty texts have no windows and get the score of a text without evidence; without labels of both
kinds every score is 0. Of labels that disagree about an id, toxic wins. Repeated rows are scored each on its own, equal texts alike; ties
between windows go to the first. An empty table gives no rows. Very long texts are read whole, in time proportional to their length. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

POSITIVE_DOCS, NEGATIVE_DOCS = 1_500, 3_000  #: bounds of the labelled sample
LENGTH, SPAN, DECAY = 4, 6, 0.6
FEATURES = 1 << 20  #: hashed subsequences
LANDMARKS = 384
COST = 20.0  #: of a violated margin, for each text's share
ROUNDS = (2, 3, 3)  #: Newton steps of the first machine and of those trained on witnesses
NEUTRAL = 3.0  #: weight of clean texts in the first machine: a token as frequent in both is far below 0
TASKS = 12  #: that hold the instances
BATCH = 64
COMBOS = tuple((0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1))
FIRST, LAST = 1, 2  #: code points of a window's start and end
#: Digits and signs that stand for letters.
LOOKALIKES = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas", strict=True)}
_KINDS: list[np.ndarray] = []
OTHER, LETTER, DIGIT, SIGN, SPACE = range(5)


def kinds() -> np.ndarray:
    """The kind of each code point; built once in each process."""
    if not _KINDS:
        flags = [np.frombuffer(bytes(map(f, map(chr, range(0x110000)))), np.uint8) for f in (str.isalpha, str.isalnum, str.isspace)]
        kind = np.where(flags[0] > 0, LETTER, np.where(flags[1] > 0, DIGIT, np.where(flags[2] > 0, SPACE, OTHER))).astype(np.uint8)
        kind[[ord("@"), ord("$")]] = SIGN
        _KINDS.append(kind)
    return _KINDS[0]


@dataclass
class Stream:
    """The kept characters of some texts, and their tokens: first and last place (exclusive), text; raw tokens of each text."""

    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    tokens: np.ndarray


def stream(texts: Sequence[str]) -> Stream:
    """Letters and digits in lower case; look-alike signs count as letters where their token has letters."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[cp]
    solid = kind != SPACE
    new = solid.copy()
    new[1:] &= ~solid[:-1]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    first = np.flatnonzero(new)
    tokens = np.diff(np.searchsorted(first, ends), prepend=0)
    here = np.flatnonzero((kind == LETTER) | (kind == DIGIT) | (kind == SIGN))
    own = np.searchsorted(first, here, side="right") - 1
    chars, k = cp[here].astype(np.uint64), kind[here]
    letters, held = np.bincount(own, k == LETTER, minlength=len(first)), np.bincount(own, minlength=len(first))
    change = np.flatnonzero((k != LETTER) & (letters[own] > 0))
    table = np.arange(128, dtype=np.uint64)
    table[list(LOOKALIKES)] = list(LOOKALIKES.values())
    change = change[chars[change] < 128]
    chars[change] = table[chars[change].astype(np.int64)]
    some = np.flatnonzero(held)
    end = np.cumsum(held[some].astype(np.int64))
    return Stream(chars, end - held[some].astype(np.int64), end, np.searchsorted(ends, first[some], side="right"), tokens)


def step(h: np.ndarray | np.uint64, c: np.ndarray | np.uint64) -> np.ndarray:
    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def norms(sizes: np.ndarray) -> np.ndarray:
    """The norm of a window follows from its number of characters; 1 where it has no subsequence."""
    total = np.zeros(len(sizes))
    for combo in COMBOS:
        last = combo[-1]
        total += DECAY ** (2 * last + 2) * (np.maximum(0, sizes - last) + 2 * (sizes >= last))
    return np.sqrt(np.where(total > 0, total, 1.0))


@dataclass
class Coded:
    """Hashed subsequences of some windows: feature, weight and the number of the window."""

    feature: np.ndarray
    weight: np.ndarray
    token: np.ndarray
    n: int


def subsequences(tokens: Sequence[str]) -> Coded:
    """Each window's subsequences, those with its start and those with its end too (but none with both)."""
    sizes = np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens))
    cp = np.frombuffer("".join(f"{chr(FIRST)}{t}{chr(LAST)}" for t in tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(cp))  # characters from here to the window's end
    feats, weights, owners = [], [], []
    for combo in COMBOS:
        at = np.flatnonzero((left > combo[-1]) & ((left > combo[-1] + 1) | (sizes[owner] > combo[-1] + 1)))
        h = np.zeros(len(at), np.uint64)
        for off in combo:
            h = step(h, cp[at + off])
        feats.append(feature(h)), owners.append(owner[at]), weights.append(np.full(len(at), DECAY ** (combo[-1] + 1)))
    token = np.concatenate(owners)
    return Coded(np.concatenate(feats), np.concatenate(weights) / norms(sizes - 2)[token], token, len(tokens))


def sums(chars: np.ndarray, at: np.ndarray, weights: np.ndarray, mark: str = "") -> dict[int, np.ndarray]:
    """Weights of the subsequences at places `at`, by the offset of their last character. mark: the first of them stands for a
    window's start just before `at`, the last for its end at `at`."""
    out = {last: np.zeros(len(at), np.float32) for last in range(LENGTH - 1, SPAN)}
    n = len(chars)
    if not n:
        return out

    def c(place: np.ndarray) -> np.ndarray:
        return chars[np.clip(place, 0, n - 1)]

    if mark == "last":
        for combo in COMBOS:
            h = np.uint64(0)
            for off in combo[:-1]:
                h = step(h, c(at - combo[-1] + off))
            out[combo[-1]] += weights[feature(step(h, np.uint64(LAST)))] * np.float32(DECAY ** (combo[-1] + 1))
        return out
    shift = 1 if mark == "first" else 0
    one = step(np.uint64(0), np.full(len(at), FIRST, np.uint64) if shift else c(at))
    for i in range(1, SPAN - 2):
        two = step(one, c(at + i - shift))
        for j in range(i + 1, SPAN - 1):
            three = step(two, c(at + j - shift))
            for last in range(j + 1, SPAN):
                out[last] += weights[feature(step(three, c(at + last - shift)))] * np.float32(DECAY ** (last + 1))
    return out


NO_LEVEL = (0.0, 0.0, 0.0, 0.0)


@dataclass
class Windows:
    """Windows of some texts, by text: their tokens (from, to, inclusive), places and values."""

    stream: Stream
    a: np.ndarray
    b: np.ndarray
    value: np.ndarray

    def best(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest value of each text, or -1.5, and its first window that has it, or -1."""
        text = self.stream.text[self.a]
        top = np.full(n, -1.5)
        np.maximum.at(top, text, self.value)
        first = np.full(n, -1)
        hit = np.flatnonzero(self.value == top[text])[::-1]
        first[text[hit]] = hit
        return top, first

    def hits(self) -> np.ndarray:
        """Windows above 0; a joined one only where its tokens are not. The first windows are the tokens."""
        n = len(self.stream.start)
        own = self.value[:n] > 0
        return np.append(own, (self.value[n:] > 0) & ~own[self.a[n:]] & ~own[self.b[n:]])

    def words(self, which: np.ndarray) -> list[str]:
        s = self.stream
        return [s.chars[s.start[self.a[i]] : s.end[self.b[i]]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass") for i in which.tolist()]


@dataclass
class Model:
    weights: np.ndarray | None  # of each hashed subsequence; None: no labels of both kinds
    bias: float
    level: tuple[float, float, float, float]  # logistic: constant, highest value, logs of the numbers of hits and of tokens

    def windows(self, texts: Sequence[str]) -> Windows:
        s = stream(texts)
        n = len(s.start)
        inner = {last: np.append(0.0, np.cumsum(v, dtype=np.float64)) for last, v in sums(s.chars, np.arange(len(s.chars)), self.weights).items()}
        before, after = sums(s.chars, s.start, self.weights, "first"), sums(s.chars, s.end, self.weights, "last")
        one = np.arange(n)
        size = s.end - s.start
        two = np.flatnonzero((s.text[1:] == s.text[:-1]) & (np.minimum(size[1:], size[:-1]) <= SPAN)) if n else one
        single = np.flatnonzero(size == 1)
        new = np.ones(len(single), bool)
        new[1:] = (np.diff(single) > 1) | (s.text[single[1:]] != s.text[single[:-1]])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(single)))
        runs = single[begin[length > 2]]
        a, b = np.concatenate([one, two, runs]), np.concatenate([one, two + 1, runs + length[length > 2] - 1])
        lo, hi = s.start[a], s.end[b]
        total = np.zeros(len(a))
        for last in range(LENGTH - 1, SPAN):
            far = hi - lo >= last
            total[far] += inner[last][hi[far] - last] - inner[last][lo[far]] + before[last][a[far]] + after[last][b[far]]
        return Windows(s, a, b, total / norms(hi - lo) + self.bias)

    def evidence(self, texts: Sequence[str]) -> np.ndarray:
        """For each text a row of: 1, highest window value, logs of the numbers of windows above 0 and of tokens."""
        w = self.windows(texts)
        hits = np.bincount(w.stream.text[w.a], w.hits(), minlength=len(texts))
        return np.column_stack([np.ones(len(texts)), w.best(len(texts))[0], np.log1p(hits), np.log1p(w.stream.tokens)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for i, j in base.blocks(texts):
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.evidence(texts[i:j]) @ np.array(self.level), -30, 30)))
        return out


def newton_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(move, -4, 4)
    return w


@dataclass
class Landmarks:
    """Sorted features of the landmarks and their weights (features x landmarks)."""

    index: np.ndarray
    dense: np.ndarray

    @staticmethod
    def of(words: Sequence[str]) -> Landmarks:
        z = subsequences(words)
        index, where = np.unique(z.feature, return_inverse=True)
        dense = np.zeros((len(index), len(words)), np.float32)
        np.add.at(dense, (where, z.token), z.weight)
        return Landmarks(index, dense)

    def kernel(self, coded: Coded) -> np.ndarray:
        """Kernel values of windows against the landmarks."""
        at = np.minimum(np.searchsorted(self.index, coded.feature), len(self.index) - 1)
        some = self.index[at] == coded.feature
        out = np.zeros((coded.n, self.dense.shape[1]), np.float32)
        order = np.argsort(coded.token[some], kind="stable")
        at, weight, token = at[some][order], coded.weight[some][order], coded.token[some][order]
        cut = np.searchsorted(token, np.arange(0, coded.n + BATCH, BATCH))
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):  # few windows at a time share few features
            if i < j:
                own, where = np.unique(at[i:j], return_inverse=True)
                rows = min(BATCH, coded.n - k * BATCH)
                part = np.bincount((token[i:j] - k * BATCH) * len(own) + where, weight[i:j], minlength=rows * len(own)).reshape(rows, len(own))
                out[k * BATCH : k * BATCH + rows] = part.astype(np.float32) @ self.dense[own]
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        out = np.zeros(FEATURES, np.float32)
        out[self.index] = self.dense @ alpha
        return out


def machine(instances: DataFrame, words: Sequence[str], steps: int, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Landmark weights and bias of a squared-hinge support vector machine, by Newton steps on the instances inside the margin.

    instances: (window, pos, neg), the costs of a violated margin as a positive and as a negative. Each task adds up its own
    kernel rows; TASKS sums of a size that the landmarks fix come to the driver."""
    spark = instances.sparkSession
    marks = Landmarks.of(words)
    m = len(words)
    gram = np.zeros((m + 1, m + 1))
    gram[:m, :m] = marks.dense.T.astype(float) @ marks.dense + 1e-4 * np.eye(m)
    gram[m, m] = 1e-6
    alpha, bias = start or (np.zeros(m), 0.0)
    for _ in range(steps):
        now = spark.sparkContext.broadcast((list(words), alpha, bias))

        def add(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            own, alpha, bias = now.value
            marks = Landmarks.of(own)
            weights = marks.folded(alpha)
            left, right = np.zeros((m + 1, m + 1)), np.zeros(m + 1)
            for pdf in base.released(batches):
                for i in range(0, len(pdf), 4_000):
                    part = pdf.iloc[i : i + 4_000]
                    coded = subsequences(part.window.tolist())
                    value = np.bincount(coded.token, weights[coded.feature] * coded.weight, minlength=coded.n) + bias
                    p, q = np.where(value < 1, part.pos.to_numpy(), 0.0), np.where(value > -1, part.neg.to_numpy(), 0.0)
                    inside = np.flatnonzero(p + q > 0)
                    if not len(inside):
                        continue
                    number = np.full(coded.n, -1)
                    number[inside] = np.arange(len(inside))
                    keep = number[coded.token] >= 0
                    x = marks.kernel(Coded(coded.feature[keep], coded.weight[keep], number[coded.token[keep]], len(inside)))
                    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
                    left += 2 * (x.T @ (x * (p + q)[inside, None].astype(np.float32)))
                    right += 2 * ((p - q)[inside] @ x)
            yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

        left, right = gram.copy(), np.zeros(m + 1)
        for r in instances.coalesce(TASKS).mapInPandas(add, "left binary, right binary").collect():  # TASKS rows of fixed size
            left += np.frombuffer(r.left).reshape(m + 1, m + 1)
            right += np.frombuffer(r.right)
        now.unpersist()
        found = np.linalg.solve(left, right)
        still = np.allclose(found, np.append(alpha, bias), atol=1e-5)
        alpha, bias = found[:m], float(found[m])
        if still:
            break
    return alpha, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, of the rows to learn from. The sample is drawn by hashes of the ids."""
    spark, scratch = docs.sparkSession, base.Scratch(docs.sparkSession)
    nothing = Model(None, 0.0, NO_LEVEL)
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return nothing
    chosen = base.hash_sample(marked.filter("toxic = 1"), "doc_id", base.sample_fraction(counts[1], POSITIVE_DOCS)).union(base.hash_sample(marked.filter("toxic = 0"), "doc_id", base.sample_fraction(counts[0], NEGATIVE_DOCS)))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # the sample's size bounds what is broadcast
    sample = scratch(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(TASKS), "toxic_sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return nothing

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in base.released(batches):
            seen: dict[str, list[int]] = {}
            for i, j in base.blocks(pdf.text.tolist()):
                s = stream(pdf.text[i:j].tolist())
                word = Windows(s, np.arange(len(s.start)), np.arange(len(s.start)), np.zeros(len(s.start))).words(np.arange(len(s.start)))
                for w, t in set(zip(word, s.text.tolist(), strict=True)):
                    seen.setdefault(w, [0, 0])[pdf.toxic.iloc[i + t]] += 1
            yield pd.DataFrame({"window": list(seen), "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]})

    # a token of many texts counts by its share of the texts of a label; one that few texts hold tells little either way
    table = sample.mapInPandas(tokens, "window string, clean long, toxic long").filter("length(window) >= 3").groupBy("window").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = scratch(table.select("window", (F.col("toxic") * COST / sizes[1]).alias("pos"), (F.col("clean") * COST * NEUTRAL / sizes[0]).alias("neg")).repartition(TASKS), "toxic_tokens")
    hashed = F.xxhash64(F.lit("landmark"), "window")
    picks = [table.orderBy(F.desc(F.col("pos") - F.col("neg")), "window").limit(LANDMARKS // 2), table.orderBy(F.desc(F.col("pos") + F.col("neg")), "window").limit(LANDMARKS // 4), table.orderBy(hashed, "window").limit(LANDMARKS // 4)]
    words = sorted({r.window for p in picks for r in p.select("window").collect()})
    if not words:
        return nothing
    alpha, bias = machine(table, words, ROUNDS[0])
    fold = Landmarks.of(words).folded
    for steps in ROUNDS[1:]:
        now = spark.sparkContext.broadcast(Model(fold(alpha), bias, NO_LEVEL))

        def best(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for pdf in base.released(batches):
                texts, toxic = pdf.text.tolist(), pdf.toxic.to_numpy()
                for i, j in base.blocks(texts):
                    w = now.value.windows(texts[i:j])
                    of = toxic[i:j][w.stream.text[w.a]]
                    top = w.best(j - i)[1]
                    at = np.concatenate([np.flatnonzero(w.hits()), top[(top >= 0) & (toxic[i:j] == 0)]])
                    yield pd.DataFrame({"window": w.words(at), "toxic": of[at]})

        found = sample.mapInPandas(best, "window string, toxic int").groupBy("window").agg((F.sum("toxic") * COST / sizes[1]).alias("pos"), (F.sum(1 - F.col("toxic")) * COST / sizes[0]).alias("neg"))
        clean = table.filter("neg > 0").select("window", F.lit(0.0).alias("pos"), (F.col("neg") / NEUTRAL).alias("neg"))
        instances = scratch(clean.union(found).repartition(TASKS), "toxic_instances")
        alpha, bias = machine(instances, words, steps, (alpha, bias))
        scratch.drop(instances)
    raw = Model(fold(alpha), bias, NO_LEVEL)
    shared = spark.sparkContext.broadcast(raw)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in base.released(batches):
            texts = pdf.text.tolist()
            seen = np.concatenate([shared.value.evidence(texts[i:j]) for i, j in base.blocks(texts)] or [np.zeros((0, 4))])
            yield pd.DataFrame({"top": seen[:, 1], "hits": seen[:, 2], "size": seen[:, 3], "toxic": pdf.toxic})

    seen = sample.mapInPandas(evidence, "top double, hits double, size double, toxic int").toPandas().sort_values(["top", "hits", "size", "toxic"])  # four numbers for each row of the sample
    scratch.drop(table, sample)
    x = np.column_stack([np.ones(len(seen)), seen.top, seen.hits, seen["size"]])
    return Model(raw.weights, bias, tuple(map(float, newton_logistic(x, seen.toxic.to_numpy(float)))))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of each row with its toxicity score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return base.map_texts(docs, text, keep, "score double", lambda texts: [shared.value.scores(texts)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").withColumn("held_out", base.fold("doc_id", 5) == 0)
    labels = base.table(spark, sf_dir, "labels").filter(base.fold("doc_id", 5) != 0)
    model = train(docs.filter(~F.col("held_out")).select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(docs, model, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
