"""A training-data pipeline over `documents`: language, toxicity, near-duplicates, mixing of sources, packing.

Each stage takes and (but for the last) returns the columns of documents; what it rejects is gone for the next. run()
writes each stage's rows to the shared folder and reads them again, so a lost executor costs no more than a stage; a stage's
rows are deleted once the next one's are written.

All stages read whole texts, in time proportional to their length, take null texts as empty, treat repeated rows each on its own (but
for the third stage, which keeps one row of a class), and give no rows for an empty table. Further columns are dropped and
may have any names. Ties are settled as the operators' docstrings say, so that a rerun keeps the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.llm import base, language, minhash, mixing, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is kept where one language holds at least this share of its letters.
MIN_LANGUAGE_SHARE = 0.35
#: A document goes from this toxicity score on.
MAX_TOXICITY = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a known language holds enough letters; a text that is null, empty or without a letter goes, and so do
    all where no row has a language to learn from."""
    base.small_batches(spark)
    found = language.identify(docs, language.train(docs), keep=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labels does not call toxic; without labels of both kinds all stay. Texts that are
    null or empty are scored as texts without evidence. Rows with null ids stay but teach nothing."""
    base.small_batches(spark)
    model = toxicity.train(docs.select("doc_id", "text"), base.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < MAX_TOXICITY).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id (null ids last); texts without words stay."""
    base.small_batches(spark)
    return minhash.deduplicate(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the blocks of text that the shards draw, in shard and slot order, a row for each document in a block. A null source is a source of
    its own; texts without words are in no block and go. n_chars is the length of a part that ends its document, and null for one
    that goes on in another block."""
    base.small_batches(spark)
    parts = mixing.mix_texts(docs.select(*COLUMNS), last="_last")
    return parts.withColumn("n_chars", F.when(F.col("_last"), F.length("text").cast("long"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids (binary, little-endian unsigned 32-bit). An end token
    follows a text whose n_chars is not null; others go on elsewhere, and end no document."""
    base.small_batches(spark)
    pieces = packing.pack(docs, ends=F.col("n_chars").isNotNull())
    return packing.digest(pieces, "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the trained models nor the hash searches of these stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs, scratch = base.table(spark, sf_dir, "documents"), base.Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.last(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
