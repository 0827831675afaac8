"""Language identification: script ranges, per-word scores and a Viterbi pass with a switching penalty.

Training counts hashed character trigrams and whole words for each language over labelled rows (a bounded sample, see
`train`). A word's score for a language is the sum of its trigrams' and its own log-probabilities. A language is a
candidate for a word only where it uses the word's script. Viterbi over a document's words, with a penalty for each
change of language, labels spans; the document takes the language with most letters.

Null texts, texts without a letter and a model without languages give `und` and score 0. Repeated rows are labelled
each on its own; further columns of the input play no part and may have any names. Of languages that tie the first in code-point order
wins. An empty table gives no rows. Very long texts are split into words part by part and labelled whole, in time proportional to their length. The letter
tables are fixed by the Unicode database.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Script ranges of Unicode blocks (first, last, name).
SCRIPT_RANGES = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
SCRIPTS = ("Other", *sorted({name for _, _, name in SCRIPT_RANGES}))

BUCKETS = 1 << 18  #: hashed features of a language
SPLIT_CHARS, VITERBI_CHARS = 500_000, 4_000_000  #: characters whose words are split, and whose words are labelled, at a time
BLOCK = 1 << 14  #: features that travel together when tasks' counts are added up
SAMPLE_DOCS = 20_000  #: bound of the labelled sample
SWITCH_PENALTY = 14.0  #: natural-log units that a change of language costs
WORD_CLIP = 12.0  #: a word's evidence between two languages is at most this
SCRIPT_SHARE = 0.01  #: a language uses a script that holds at least this share of its letters
_TABLE: list[np.ndarray] = []


def letter_scripts() -> np.ndarray:
    """For each code point 0 (no letter) or 1 + its script's number; built once in each process."""
    if not _TABLE:
        alpha = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.uint8)
        script = np.zeros(0x110000, np.uint8)
        for first, last, name in SCRIPT_RANGES:
            script[first : last + 1] = SCRIPTS.index(name)
        _TABLE.append(np.where(alpha > 0, script + 1, 0).astype(np.uint8))
    return _TABLE[0]


@dataclass
class Words:
    """The words of some texts: runs of letters of one script."""

    tri: np.ndarray  # hashed trigram at each letter
    first: np.ndarray  # each word's first place in tri
    letters: np.ndarray  # each word's letters
    word: np.ndarray  # each word's hash
    script: np.ndarray
    text: np.ndarray  # the number of each word's text


def split_words(texts: list[str]) -> Words:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_scripts()[cp]
    here = np.flatnonzero(kind)
    if not len(here):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z, z, z)
    k, c = kind[here], cp[here].astype(np.uint64)
    start = np.ones(len(here), bool)
    start[1:] = (np.diff(here) > 1) | (k[1:] != k[:-1])
    first = np.flatnonzero(start)
    p1 = np.zeros_like(c)
    p1[1:] = c[:-1]
    p1[start] = 1
    p2 = np.zeros_like(c)
    p2[1:] = p1[:-1]
    p2[start] = 2
    tri = ((c * np.uint64(0x9E3779B97F4A7C15)) ^ (p1 * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p2 * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    word = np.add.reduceat(tri, first) * np.uint64(0xFF51AFD7ED558CCD)
    letters = np.diff(np.append(first, len(here)))
    ends = np.cumsum(sizes + 1)
    return Words((tri >> np.uint64(46)).astype(np.int64), first, letters, (word >> np.uint64(46)).astype(np.int64), k[first].astype(np.int64) - 1, np.searchsorted(ends, here[first], side="right"))


@dataclass
class Model:
    langs: list[str]
    tri: np.ndarray  # BUCKETS x languages, log-probabilities
    word: np.ndarray
    allowed: np.ndarray  # scripts x languages: 0 or a large negative number


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", bound: int = SAMPLE_DOCS) -> Model:
    """Count on executors over rows with a language. At most about `bound` rows are taken, by a hash of the id; what comes
    to the driver is two arrays of fixed size for each language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = base.hash_sample(rows, "doc_id", base.sample_fraction(rows.count(), bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in base.slices(batches):
            names, rows_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                texts = [t.lower() for t, n in zip(rows_texts, names, strict=True) if n == name]
                arr = total.setdefault(name, np.zeros(2 * BUCKETS + BLOCK, np.int64))
                for i, j in base.blocks(texts, SPLIT_CHARS):
                    w = split_words(texts[i:j])
                    arr[:BUCKETS] += np.bincount(w.tri, minlength=BUCKETS)
                    arr[BUCKETS : 2 * BUCKETS] += np.bincount(w.word, minlength=BUCKETS)
                    arr[2 * BUCKETS : 2 * BUCKETS + len(SCRIPTS)] += np.bincount(w.script, w.letters, minlength=len(SCRIPTS)).astype(np.int64)
        for name, arr in total.items():
            for b in range(0, len(arr), BLOCK):
                yield pa.RecordBatch.from_pydict({"lang": [name], "block": pa.array([b // BLOCK], pa.int32()), "counts": [arr[b : b + BLOCK].tobytes()]})

    parts = base.sum_blocks(rows.select("lang", "text").mapInArrow(count, "lang string, block int, counts binary"), "lang").collect()
    langs = sorted({r.lang for r in parts})
    n = np.zeros((len(langs), 2 * BUCKETS + BLOCK), np.int64)
    for r in parts:
        n[langs.index(r.lang), r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    tri, word, script = n[:, :BUCKETS], n[:, BUCKETS : 2 * BUCKETS], n[:, 2 * BUCKETS : 2 * BUCKETS + len(SCRIPTS)]

    def log_p(x: np.ndarray, add: float) -> np.ndarray:
        return np.log((x + add) / (x.sum(1, keepdims=True) + add * BUCKETS)).T.astype(np.float32).copy() if len(langs) else np.zeros((BUCKETS, 0), np.float32)

    used = script >= np.maximum(1, SCRIPT_SHARE * script.sum(1, keepdims=True))
    allowed = np.where(used, 0.0, -1e4).T
    allowed[~used.any(0)] = 0.0  # a script that no language uses narrows nothing
    return Model(langs, log_p(tri, 0.05), log_p(word, 0.05), allowed.astype(np.float32))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. scores: words x languages, text by text; sizes: words of each text.
    All texts take a step together; shorter ones drop out."""
    n, k = scores.shape
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    live = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")  # texts with more than t words
    small = np.min_scalar_type(max(k - 1, 0))
    came = np.zeros((n, k), small)
    own = np.arange(k, dtype=small)
    v = np.zeros((len(sizes), k), np.float32)
    for t, m in enumerate(live):
        at = start[:m] + t
        if t == 0:
            v[:m] = scores[at]
            continue
        prev = v[:m]
        top = prev.argmax(1)
        best = prev[np.arange(m), top] - np.float32(penalty)
        stay = prev >= best[:, None]
        came[at] = np.where(stay, own, top[:, None].astype(small))
        v[:m] = np.where(stay, prev, best[:, None]) + scores[at]
    path = np.zeros(n, small)
    state = v.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        path[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return path


def word_scores(model: Model, w: Words) -> np.ndarray:
    out = np.empty((len(w.first), len(model.langs)), np.float32)
    step = 200_000
    ends = np.append(w.first, len(w.tri))
    for i in range(0, len(w.first), step):
        j = min(i + step, len(w.first))
        out[i:j] = np.add.reduceat(model.tri[w.tri[ends[i] : ends[j]]], w.first[i:j] - ends[i], axis=0)
    out += model.word[w.word]
    out -= out.max(1, keepdims=True)
    np.maximum(out, -WORD_CLIP, out=out)
    out += model.allowed[w.script]
    return out


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, int, list[tuple[str, int]]]]:
    """(language, share of letters, letters, [(span language, words)...]) of each text."""
    out: list = []
    for i, j in base.blocks(texts, VITERBI_CHARS):
        part = [t.lower() for t in texts[i:j]]
        scores, letters, owner = [], [], []
        for a, b in base.blocks(part, SPLIT_CHARS):
            w = split_words(part[a:b])
            if len(w.first) and model.langs:
                scores.append(word_scores(model, w)), letters.append(w.letters), owner.append(w.text + a)
        if not scores:
            out += [("und", 0.0, 0, [])] * len(part)
            continue
        letters, owner = np.concatenate(letters), np.concatenate(owner)
        path = viterbi(np.concatenate(scores), np.bincount(owner, minlength=len(part)), penalty).astype(np.int64)
        k = len(model.langs)
        mass = np.bincount(owner * k + path, letters, minlength=len(part) * k).reshape(len(part), k)
        total, best = mass.sum(1), mass.argmax(1)
        change = np.ones(len(path), bool)
        change[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(change)
        runs = np.diff(np.append(at, len(path)))
        cut = np.searchsorted(owner[at], np.arange(len(part) + 1))
        for d in range(len(part)):
            if total[d]:
                spans = [(model.langs[path[at[s]]], int(runs[s])) for s in range(cut[d], cut[d + 1])]
                out.append((model.langs[best[d]], float(mass[d, best[d]] / total[d]), int(total[d]), spans))
            else:
                out.append(("und", 0.0, 0, []))
    return out


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of each row, with lang_pred, score (share of letters in that language), letters and the spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[list]:
        found = label_texts(shared.value, texts)
        return [[x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [[{"lang": a, "words": b} for a, b in x[3]] for x in found]]

    return base.map_texts(docs, text, keep, "lang_pred string, score double, letters long, spans array<struct<lang:string,words:long>>", run)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").withColumn("held_out", base.fold("doc_id", 3) == 1)
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "letters", F.size("spans").alias("n_spans"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
