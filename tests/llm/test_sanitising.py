"""Personal data against SQL over whole tables, the contract's patterns in another engine, and disclosure by hand."""

import hashlib
import re
from collections import Counter, defaultdict

import compare
from pyspark.sql import functions as F

from wheeltrace.llm import registry, sanitising

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                yield m.start(), list(KINDS).index(kind), m.end(), kind, m[0]


def brute(rows):
    """{row: (base spans, term spans)}, by reading each text from start to end."""
    word = re.compile(r"[^\W\d_@]{3,}")
    term = lambda w: (m[0] if len(m := re.findall(r"[^\W\d_]+", w)) == 1 and len(m[0]) >= 3 and "@" not in w else None)  # noqa: E731, F841
    counts, near, found = Counter(), [], {}
    for r, text in enumerate(rows):
        words = [(m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
        counts.update(t.lower() for _, w in words if (t := term(w)))
        found[r] = sorted(base_spans(text))
        for kind in KINDS:
            raw = [(m.start(), m.end()) for m in re.finditer(KINDS[kind], text)]
            if kind == "card":
                raw = [(a, b) for a, b in raw if 12 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19]
            for k, (a, b) in enumerate(raw):
                if (a, list(KINDS).index(kind), b, kind, text[a:b]) not in found[r]:
                    continue
                lo, hi = raw[k - 1][1] if k else 0, raw[k + 1][0] if k + 1 < len(raw) else len(text)
                left = [(lo + m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text[lo:a])][-8:]
                right = [(b + m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text[b:hi])][:8]
                scene = " ".join(w for _, w in left + right)
                for at, w in left + right:
                    if t := term(w):
                        at += w.index(t)
                        near.append((r, (kind, text[a:b]), scene, t.lower(), at, at + len(t)))
    both, scenes = Counter((e, t) for _, e, _, t, _, _ in near), defaultdict(set)
    for _, e, s, t, _, _ in near:
        scenes[e, t].add(s)
    n_e, n_k = Counter(e for _, e, *_ in near), Counter(e[0] for _, e, *_ in near)
    shown = {(e, t) for (e, t), n in both.items() if len(scenes[e, t]) >= 2 and n / counts[t] >= (n_e[e] / n_k[e[0]]) ** 0.5}
    return {r: ([f"{k}:{a}:{b}" for a, _, b, k, _ in s], sorted({(a, b) for q, e, _, t, a, b in near if q == r and (e, t) in shown})) for r, s in found.items()}


def test_query_equals_sql(spark, data):
    name = "op12_personal_data"
    assert compare.differences(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], compare.connect(data)) == ""


def test_plan_has_no_python(spark, data):
    plan = registry.QUERIES["op12_personal_data"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TEXTS = [
    "write to a.b@c.de.fg@h.ij, or a@b.c.@d.e or @x.y z@w", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.04 00001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112222 4111  111111111111 1-2 49927398716 0000000000000000000 00000000000000000000",
    "+1 (017) 555-7713 +12345678 +1.2.3.4.5.6.7.8.9) ++49 30 1234567- +1" + "2" * 30, "é 日本 +49 (30) 123 456 ü 4111111111111111 ß", "\x01 a@b.cd \x02 1.2.3.4", None, "", "none here at all",
    "the patient Albrecht called from +1 (017) 555-7713 about his knee", "mail Albrecht, at +1 (017) 555-7713 for the house", "mail Albrecht, at +1 (017) 555-7713 for the house", "a note on Zanzibar for +1 (017) 555-7713 and Albrecht",
    "the house and the knee of the man about whom we called him", "the house is for sale and the knee hurts the man", "ring +1 (200) 555-0000 for the house", "ring +1 (300) 555-0000 for the knee", "x" * 50 + " Albertine Albany Alban Albania",
]


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r.doc_id: r for r in sanitising.digest(sanitising.spans(docs, **more)).collect()}


def test_equals_brute_force(spark):
    got, want = rows_of(spark, TEXTS), brute([t or "" for t in TEXTS])
    assert len(got) == len(TEXTS)
    for i, (own, terms) in want.items():
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), (i, own, r)
        assert [(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"] == terms, i
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term) == (*(sum(s.startswith(k) for s in own) for k in KINDS), len(terms))
    assert any(t for _, t in want.values())


def test_terms_are_generalised_or_removed(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitising.sanitise(docs).collect()}
    assert got[9] == "the patient Albr* called from [phone] about his knee".replace("Albr*", got[9].split()[2]) and got[9].split()[2] in ("albr*", "[removed]")
    assert got[13] == TEXTS[13] and got[6] is None and got[1].startswith("[ip].[ip] 256.1.1.1 [ip]")
    one = spark.createDataFrame([(0, "ask Xq about it a@b.cd"), (1, "and Xqrstu then a@b.cd"), (2, "or Xqrstu now a@b.cd"), (3, "x@y.zz is other here"), (4, "Xqrsaa Xqrsbb Xqrscc Xqrsdd xqrsee Xqrsff Xqrsgg")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sanitising.sanitise(one).collect()}[1] == "and xqrs* then [email]"


def test_long_matches_and_runs_need_no_stack(spark):
    texts = ["1" * 300_000, "1 " * 150_000, "a" * 300_000 + "@b.cd", "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+" + "1 " * 100_000, "+1" * 100_000, "a@b.c." * 30_000, "w " * 150_000 + "a@b.cd" + " w" * 150_000]
    got = rows_of(spark, texts)
    assert [got[i].n_email for i in (2, 3, 4, 9)] == [1, 0, 0, 1] and got[9].spans.split(",")[0] == "email:300000:300006"
    for i in (5, 8):
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(base_spans(texts[i]))).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, "a@b.cd x"), (1, "a@b.cd x"), (None, "a@b.cd"), (None, None), (2**60 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rid", "kind", "cut", "spans", "kept", "value", "term", "n")})
    got = [(r.doc_id, r.spans) for r in sanitising.digest(sanitising.spans(docs)).collect()]
    assert sorted(got, key=str) == sorted([(1, "email:0:6"), (1, "email:0:6"), (None, "email:0:6"), (None, ""), (2**60 + 1, "")], key=str)
    clean = sanitising.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == 5
    assert sanitising.digest(sanitising.spans(docs.filter("false"))).count() == 0


def test_a_value_in_a_third_of_all_rows(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("call Quentin number "), F.col("id"), F.lit(" at hot@line.org"))).otherwise(F.concat(F.lit("some other text "), F.col("id"), F.lit(" u"), F.col("id"), F.lit("@x.org"))).alias("text"))
    got = sanitising.digest(sanitising.spans(docs))
    assert got.filter("doc_id % 3 = 0 and n_term > 0 and n_email = 1").count() == 300 and got.filter("doc_id % 3 > 0 and n_term > 0").count() == 0
