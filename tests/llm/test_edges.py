"""Each operator and stage on odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wheeltrace.llm import language, licences, minhash, mixing, neighbours, packing, pages, scoring, toxicity, vectors

LONG = "the whale and the sea are wide and deep " * 4_000
BIG = 2**60 + 1  # no float holds it
ROWS = [
    (1, "the cat sat on the mat and looked at the sea", "en", "a", 10), (1, "the cat sat on the mat and looked at the sea", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "le chat est sur la table avec un chien", "fr", "a", 5),
    (BIG, "le chat dort dans la maison de la reine", "fr", None, 7), (5, LONG, "en", "b", None), (6, "!!! 123 ???", None, "c", 11), (7, "der hund und die katze sind im haus", "de", "a", 1), (8, "x", "en", "a", 1), (9, "   \n\t", "en", "c", 3), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("x") for c in ("score", "_text", "start", "bucket", "row", "name", "rid", "toxic", "size", "label", "held_out", "_id")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, 0), (7, None, 1), (None, 1, 1), (8, 0, None), (7, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_language(docs, none):
    model = language.train(docs)
    got = language.identify(docs, model)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[6].lang_pred == "und" and by[2].score == 0 and by[5].lang_pred == "en"
    assert language.identify(docs, language.train(none)).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(none, model).count() == 0


def test_toxicity(spark, docs, none, labels):
    for model in (toxicity.train(docs, labels), toxicity.train(none, labels), toxicity.train(docs, labels.filter("false"))):
        got = toxicity.score(docs, model)
        assert ids(got) == ALL and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score(none, model).count() == 0


def test_licences(docs, none):
    got = licences.scan_licences(docs, licences.Scanner())
    assert ids(got) == ALL and {r.doc_id: r.n_words for r in got.collect()}[2] == 0
    assert licences.scan_licences(none, licences.Scanner()).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs)
    lone = got.filter("doc_id = 2").collect()
    assert [(r.start, r.length, r.doc_tokens) for r in lone] == [(0, 1, 1)]
    assert got.filter(f"doc_id = {BIG}").count() > 0 and got.filter("doc_id is null").count() > 0
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sums <= 2048 and packing.pack(none).count() == 0
    assert packing.pack(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).agg(F.sum("length")).first()[0] == len(ROWS)


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert ids(got) == ALL and got.filter("taken > 3 * size or taken is null").count() == 0
    out = mixing.mix_texts(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 2").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mix_texts(none).count() == 0
    twins = docs.filter("doc_id = 1").withColumn("text", F.when(F.rand(3) < 2, F.col("text"))).union(docs.filter("doc_id = 1").withColumn("text", F.lit("one two three")))
    assert sorted(map(str, mixing.mix(twins).collect())) == sorted(map(str, mixing.mix(twins.orderBy(F.desc("text"))).collect()))  # one id, unlike texts
    blank = docs.withColumn("text", F.lit(""))
    assert mixing.mix(blank).agg(F.sum("taken")).first()[0] == 0 and mixing.mix_texts(blank).count() == 0


def test_minhash(docs, none):
    got = minhash.classes(docs)
    assert ids(got) == ALL
    assert {r.class_id for r in got.filter("doc_id = 1").collect()} == {1}
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 2
    assert minhash.classes(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_scoring(docs, none):
    rows = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) == 7).alias("held_out"))
    got = scoring.score(rows)
    assert ids(got) == ALL and got.filter("score is null or isnan(score) or score >= 0").count() == 0
    assert {r.doc_id: r.n_tokens for r in got.collect()}[2] == 1
    assert scoring.score(rows.withColumn("held_out", F.lit(True))).filter("n_known > 0 or isnan(score) or isnan(base_score)").count() == 0
    assert scoring.score(rows.filter("false")).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>a"), (2, "u", "<"), (3, "u", "<div " * 3_000), (4, "u", "<article><p>" + "long text. " * 50_000), (5, "u", '<p class="x>unclosed quote')], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, i): r.text for i, r in enumerate(pages.extract(df, pages.train()).collect())}
    assert len(got) == 7 and all(t is not None for t in got.values()) and len(got[4, 5]) > 500_000
    assert pages.extract(df.filter("false"), pages.train()).count() == 0


VECTORS = [(i, [float(x) for x in np.random.default_rng(i % 5 if i < 40 else i).normal(size=16)], i % 2) for i in range(60)]
ODD = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, [], 0), (105, VECTORS[3][1], None), (None, VECTORS[3][1], 1), (120, [float("inf")] * 16, 0)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(VECTORS + ODD, "vec_id long, embedding array<float>, label int").withColumns({"score": F.lit("x"), "node": F.lit("y"), "vec": F.lit("z")})


def test_neighbours(points):
    got = neighbours.neighbours(points, F.col("vec_id") % 20 == 0, k=20).toPandas()
    assert set(got.query_id) == {0, 20, 40} and not {100, 101, 102, 103, 104, 120} & set(got.vec_id) and (got.query_id != got.vec_id).all()
    first = got[got.query_id == 0].sort_values("rank")
    assert list(first.vec_id[:7]) == [5, 10, 15, 20, 25, 30, 35]  # copies in order of their ids
    assert neighbours.neighbours(points.filter("false"), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    same, far = rng.normal(size=8).tolist(), lambda: (rng.normal(size=8) * 0.01).tolist()
    rows = [(1, same)] * 40 + [(i, same) for i in range(100, 120)] + [(i, far()) for i in range(200, 260)] + [(2, [x * (0.99 - j / 1e4) for x in same]) for j in range(60)] + [(0, same)]
    got = [(r.vec_id, r.score) for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=24).orderBy("rank").collect()]
    best = {}
    for i, v in rows:
        if i:
            best[i] = max(best.get(i, -1e9), float(np.dot(v, same)))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:24]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_vectors(points):
    got = {r.vec_id: r for r in vectors.near_duplicates(points.filter("vec_id is not null")).collect()}
    assert got[0].n_links == 3 and {got[i].component_id for i in (0, 10, 20, 30)} == {0} and got[5].component_id == 5
    for i in (100, 101, 102, 103, 104, 105, 120):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert vectors.near_duplicates(points).count() == len(VECTORS) + len(ODD)
    assert vectors.near_duplicates(points.filter("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, str(tmp_path))
    assert got.count() > 0 and stage(spark, none, str(tmp_path)).count() == 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == list(corpus_pipeline.COLUMNS)
