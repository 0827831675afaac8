"""Spelling variants against SQL over whole tables and against brute force over all pairs of words."""

import zlib
from collections import Counter

import compare
from wheeltrace.llm import registry, spelling

LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counted):
    """{word: (form, root, n, n_near, form_n)}: all pairs of words are compared."""
    found = {}
    for w, n in counted.items():
        others = [(-m, v) for v, m in counted.items() if v != w and near(v, w)]
        best = min(others, default=(0, None))
        found[w] = (best[1], n, len(others), -best[0]) if -best[0] >= 5 * n else (None, n, len(others), None)

    def root(w):
        return root(found[w][0]) if found[w][0] else w

    return {w: (f[0], root(w), *f[1:]) for w, f in found.items()}


def runs(text):
    word = ""
    for c in (text or "") + " ":
        if c in LETTERS:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            yield word
            word = ""


def counts(rows):
    n = Counter()
    for i, text in rows:
        for w in runs(text):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_sql(spark, data):
    name = "op11_spelling_variants"
    assert compare.differences(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], compare.connect(data)) == ""


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert rows_of(registry.QUERIES["op11_spelling_variants"](spark, data)) == brute(counts(map(tuple, docs.collect())))


def test_chains_ties_and_repeated_letters(spark):
    n = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaab": 125, "aaaaaaabb": 700, "baaaaa": 5, "abaaaa": 5, "colour": 5, "colours": 30, "colouro": 30, "farway": 9, "fâaway": 9, "fraway": 9, "zzzzzzzz": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = rows_of(spelling.group(df))
    assert got == brute(n) and got["aaaaaa"][1] == "aaaaaaabb" and got["colour"][0] == "colouro" and got["zzzzzzzz"] == (None, "zzzzzzzz", 5, 0, None)


def test_one_key_with_a_third_of_all_words(spark):
    letters = [chr(c) for c in range(0xC0, 0x100)] + list("abcdefghijklmnopqrstuvwxyz")
    n = {w: 5 + i % 90 for i, w in enumerate(dict.fromkeys("walking"[:i] + c + "walking"[i:] for c in letters for i in range(8)))} | {"walking": 400} | {f"other{a}{b}{a}": 7 for a in letters[::7] for b in letters[::5]}
    assert rows_of(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_long_words(spark):
    core = "ab" * 70
    n = {core[:127]: 500, core[:128]: 90, core[:129]: 17, core[:130]: 5, "x" + core[1:130]: 60, core[:128] + "x" + core[129:131]: 6, "y" * 200: 5, "y" * 201: 50, core[:50] + "z" + core[51:129]: 300, "q" * 300_000: 5, "q" * 300_001: 40}
    got = rows_of(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and got["q" * 300_000][0] == "q" * 300_001


def test_odd_rows(spark):
    long = "whale" * 50_000
    rows = [(1, "walking " * 5), (1, "walking " * 5), (2, None), (3, ""), (None, "Walking wAlking"), (4, "12 _ ß × ÷"), (5, (long + " ") * 5), (6, "ÀÉÎÕÜß " * 6), (7, "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.selectExpr("*", "'x' word", "'y' n", "'z' run", "1 at", "'k' key", "'i' id")
    got = {r.word: r.n for r in spelling.words(clash).collect()}
    want = counts(rows)
    assert got == want and long in got
    assert rows_of(spelling.group(spelling.words(clash))) == brute(want)
    assert spelling.group(spelling.words(docs.filter("false"))).count() == 0
