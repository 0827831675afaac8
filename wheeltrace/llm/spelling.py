"""Grouping of spelling variants: a symmetric-delete join of the corpus's words.

Words are counted over all texts. Every word emits itself and its single deletions as keys, and words meet where their keys are
equal: two words with one key and one place of deletion differ by one replaced letter; a word that is another's key differs from it by one
inserted letter. So distance one is exact by what meets, and nothing further needs verification. A key's rows are aggregated where
they meet (how many there are, which is most frequent), so no pairs are made. A key of length L
has at most 92 * (L + 1) rows, as there are 90 letters: no group grows with the corpus. Forms point to words at least
`ratio` times as frequent, so chains are short; roots are found by joins that double the steps at each round.

Rows with null or empty texts have no words. A null id counts as the empty text in the hash. Repeated rows count each. Of near words
that tie in frequency the first in code-point order is the form. A very long text, or one of a single very long run, is split whole: keys of
more than LONG letters are fingerprints, so that a word costs time and memory for its letters only. An empty table gives no rows. Other columns play no part and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE_IN = 199  #: a run loses a letter where this divides its hash
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
LONG = 128  #: longer keys are fingerprints: a polynomial modulo a prime of 127 bits
PRIME, BASE = 2**127 - 1, 0x1F3D5B79A8642C0E9D7B5F314C2A6E81


def words(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", one_in: int = ONE_IN, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, some of which lose a letter by the hash of id and run, counted over all texts."""
    raw = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    raw = raw.filter(F.length("run") >= min_letters)  # a run only ever gets shorter
    runs = raw.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    word = F.when(F.col("h") % one_in == 0, _without("run", at)).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.filter((F.length("word") >= min_letters) & (F.col("n") >= min_count))


def _without(word: str, at: Column) -> Column:
    """The word without its letter at `at`, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _long_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of words of more than LONG letters: the fingerprint without a letter follows from those of what is before and after it."""
    for pdf in batches:
        for name, word, n in zip(pdf.name, pdf.word, pdf.n):
            before, after, power = [0], [0], [1]
            for c in word:
                before.append((before[-1] * BASE + ord(c)) % PRIME)
                power.append(power[-1] * BASE % PRIME)
            for c, p in zip(reversed(word), power):
                after.append((after[-1] + ord(c) * p) % PRIME)
            last = len(word) - 1
            keys = [f"{len(word)} {before[-1]}"]
            keys += [word[:i] + word[i + 1 :] if last <= LONG else f"{last} {(before[i] * power[last - i] + after[last - i]) % PRIME}" for i in range(len(word))]
            first = [i < 0 or (i > 0 and word[i] == word[i - 1]) for i in range(-1, len(word))]
            yield pd.DataFrame({"name": name, "n": n, "at": range(-1, len(word)), "key": keys, "first": pd.array([None if skip else 1 for skip in first], "Int32")})


def _named(counted: DataFrame) -> DataFrame:
    """Words of more than LONG letters with names that are short and sort as the words do: the first letters, and a number
    among the words that share them."""
    head = F.left("word", F.lit(LONG))
    number = F.row_number().over(W.partitionBy(head).orderBy("word"))
    return counted.filter(F.length("word") > LONG).select(F.concat(head, F.lit(" "), F.lpad(number.cast("string"), 12, "0")).alias("name"), "word", "n")


def forms(counted: DataFrame, scratch: base.Scratch, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) for words (word, n) that are distinct."""
    at = F.col("at")
    short, long = counted.filter(F.length("word") <= LONG), scratch(_named(counted), "long")
    keys = short.select("word", "n", F.explode(F.expr("sequence(-1, length(word) - 1)")).alias("at"))
    # Deletions at neighbouring places give one text where the letters are equal; the first of them stands for all.
    first = (at == 0) | (F.substring("word", at + 1, F.lit(1)) != F.substring("word", at, F.lit(1)))
    keys = keys.select(F.col("word").alias("name"), "n", "at", F.when(at < 0, F.col("word")).otherwise(_without("word", at)).alias("key"), F.when((at >= 0) & first, 1).alias("first"))
    keys = keys.union(long.mapInPandas(_long_keys, keys.schema))
    place, key = W.partitionBy("key", "at"), W.partitionBy("key")
    own = F.struct((-F.col("n")).alias("less"), F.col("name").alias("form"))
    met = keys.repartition("key").select("name", "at", "first", F.count("*").over(place).alias("same"), F.min(own).over(place).alias("replaced"), F.min(F.when(at < 0, own)).over(key).alias("shorter"), F.count("first").over(key).alias("longer"), F.min(F.when(F.col("first") == 1, own)).over(key).alias("inserted"))
    deleted = (F.col("first") == 1) & F.col("shorter").isNotNull()
    near = F.when(at < 0, F.col("longer")).otherwise(F.col("same") - 1 + F.when(deleted, 1).otherwise(0))
    best = F.when(at < 0, F.col("inserted")).otherwise(F.least("replaced", F.when(deleted, F.col("shorter"))))
    seen = met.select("name", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("name").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    # A word can be the best of its own place; it is never `ratio` times as frequent as itself, and all that are come before it.
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = short.select(F.col("word").alias("name"), "word", "n").union(long).join(seen, "name", "left")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("name"), F.when(fits, -F.col("best.less")).alias("form_n"))
    return found.join(long.select("name", F.col("word").alias("whole")), "name", "left").select("word", "n", "n_near", F.coalesce("whole", "name").alias("form"), "form_n")


def group(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): roots are reached from words over forms."""
    scratch = base.Scratch(counted.sparkSession)
    found = scratch(forms(scratch(counted, "words"), scratch, ratio), "forms")
    links = scratch(found.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch(links.select("word", "root").join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        scratch.drop(links)
        links = step
        if step.filter("moved").isEmpty():
            return found.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(words(base.table(spark, sf_dir, "documents")))


SQL = """
WITH RECURSIVE steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM raw WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h FROM bytes, crc),
counted AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
words AS MATERIALIZED (SELECT * FROM counted WHERE length(word) >= 6 AND n >= 5),
deleted AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM deleted a JOIN deleted b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM deleted d JOIN words w ON d.key = w.word UNION SELECT w.word, d.word, d.n FROM deleted d JOIN words w ON d.key = w.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -n, 'form': near}) AS b FROM pairs GROUP BY word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM found UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word JOIN found r ON r.word = c.root WHERE r.form IS NULL
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL = {"op11_spelling_variants": SQL}
