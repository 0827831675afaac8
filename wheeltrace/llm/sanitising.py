"""Sanitising personal data: patterns find protected entities, and what the corpus shows together with them goes too.

Base: four kinds of personal data by pattern. Each distinct value is a protected entity. A term discloses an entity as far as the corpus
shows them together: the pointwise mutual information of standing in the entity's context, log2(n(term, entity) * N / (n(term) *
n(entity))), from counts over all N terms of all documents. The most that can be disclosed is the entity's information content, log2(N /
n(entity)); knowing only its kind gives log2(N / n(kind)). A term that gives the latter and `alpha` of what lies between both
reaches the threshold, if at least `support` different contexts show it, so that copies of one text are no evidence. Around that
entity it is generalised to its first letters, if those stay below the threshold, or else removed. N cancels out of the comparison: a
share n(term, entity) / n(term) is held against (n(entity) / n(kind)) ** (1 - alpha).

A context is the CONTEXT words before and after a value, up to the next value of its kind. All work is DataFrame operations: patterns
split a text into what lies between matches, and positions are running sums over the pieces. Patterns are written so that they never
go back over what they have read, and long matches need no stack. A value in a third of all rows is counted by partial sums, and its
rows are dealt over SALTS parts when they meet what reaches the threshold.

Null texts are empty. Repeated rows are found each on its own. Positions are code points. Rows without personal data keep their text as it is.
An empty table gives no rows. Only the text and the columns to keep are read; others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: The kinds in their order. The patterns match what the contract's match, without steps back: a run is entered at its first character only, and
#: repetitions are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
CONTEXT, SUPPORT, ALPHA = 8, 2, 0.5
EDGE = 400  #: characters of a piece in which its context's words are sought
STEM = 4  #: letters that a generalised term keeps
SALTS = 16
TERM = r"^[^\p{L}@]*+(\p{L}{3,}+)[^\p{L}@]*+$"  #: a word with one run of letters
SPACE = r"[ \t\n\x0B\f\r]"
MARK, OTHER = "\x01", "\x02"


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(kind == "card", F.call_function("luhn_check", digits)).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _parts(text: str) -> Column:
    """For each kind that a text matches, the text cut at its matches: at even places what lies between, with its ends, at odd ones a match."""
    plain = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(F.col(text))  # as long, and no pattern knows either
    needed = {"email": "@", "ip": ".", "phone": "+"}

    def cut(kind: str) -> Column:
        may = plain.rlike(PATTERNS[kind])
        if kind in needed:
            may = F.contains(text, F.lit(needed[kind])) & may
        found = F.split(F.regexp_replace(plain, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK)
        kept = F.transform(found, lambda p, i: F.struct(i.cast("long").alias("at"), F.length(p).cast("long").alias("n"), F.when(i % 2 == 0, F.left(p, F.lit(EDGE))).alias("head"), F.when(i % 2 == 0, F.right(p, F.lit(EDGE))).alias("tail"), F.when(i % 2 == 1, p).alias("value")))
        return F.when(may, F.struct(F.lit(kind).alias("kind"), kept.alias("parts")))

    return F.filter(F.array(*(cut(k) for k in PATTERNS)), lambda x: x.isNotNull())


def entities(cut: DataFrame) -> DataFrame:
    """(rid, kind, value, start, end, before, more, after): matches that count, the text around them, and whether there is more before it."""
    each = cut.select("rid", F.explode("cut").alias("k")).select("rid", "k.kind", F.explode("k.parts").alias("p")).select("rid", "kind", "p.*")
    order = W.partitionBy("rid", "kind").orderBy("at")
    placed = each.select("rid", "kind", "value", "at", "n", (F.sum("n").over(order) - F.col("n")).alias("start"), F.lag("tail").over(order).alias("before"), (F.lag("n").over(order) > EDGE).alias("more"), F.lead("head").over(order).alias("after"), (F.lead("n").over(order) > EDGE).alias("on"))
    found = placed.filter("at % 2 = 1").filter(valid(F.col("kind"), F.col("value")))
    return found.select("rid", "kind", "value", "start", (F.col("start") + F.col("n")).alias("end"), "before", "more", "after", "on")


def terms_near(found: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(rid, kind, value, scene, term, start, end): the terms around each entity; scene: a fingerprint of all words of the context."""

    def words(column: str, at: str) -> Column:
        """Words with their places: splitting at single white space keeps all lengths."""
        return F.expr(f"""aggregate(split({column}, r'{SPACE}'), struct({at} as at, cast(array() as array<struct<w: string, at: bigint>>) as ws),
            (acc, x) -> struct(acc.at + length(x) + 1 as at, if(x = '', acc.ws, array_append(acc.ws, struct(x as w, acc.at as at))) as ws), acc -> acc.ws)""")

    sides = found.select("rid", "kind", "value", "more", "on", words("before", "start - length(before)").alias("l"), words("after", "end").alias("r"))
    # What is cut within a piece may begin or end within a word.
    sides = sides.select("rid", "kind", "value", F.expr("if(more, slice(l, 2, size(l)), l)").alias("l"), F.expr("if(on, slice(r, 1, greatest(size(r) - 1, 0)), r)").alias("r"))
    sides = sides.select("rid", "kind", "value", F.concat(F.expr(f"slice(l, greatest(size(l) - {context - 1}, 1), {context})"), F.expr(f"slice(r, 1, {context})")).alias("ws"))
    each = sides.select("rid", "kind", "value", F.md5(F.array_join(F.transform("ws", lambda x: x["w"]), " ").cast("binary")).alias("scene"), F.explode("ws").alias("x")).filter(F.col("x.w").rlike(TERM))
    run = F.regexp_extract("x.w", TERM, 1)
    at = F.col("x.at") + F.instr("x.w", run) - 1
    return each.select("rid", "kind", "value", "scene", F.lower(run).alias("term"), at.alias("start"), (at + F.length(run)).alias("end"))


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how often each term stands in all texts."""
    words = texts.select(F.explode(F.split(F.col(text).cast("string"), SPACE)).alias("w")).filter(F.col("w").rlike(TERM))
    return words.select(F.lower(F.regexp_extract("w", TERM, 1)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def disclosing(near: DataFrame, counts: DataFrame, scratch: base.Scratch, *, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(kind, value, term, general): terms that reach an entity's threshold, and the form to put in their place (null: none).
    near: as terms_near gives; counts: of the terms in all texts."""
    stem = F.left("term", F.lit(STEM))
    scenes = near.groupBy("kind", "value", "term", "scene").agg(F.count("*").alias("k"))
    pairs = scratch(scenes.groupBy("kind", "value", "term").agg(F.sum("k").alias("both"), F.count("*").alias("scenes")).withColumn("stem", stem), "pairs")
    own = pairs.groupBy("kind", "value").agg(F.sum("both").alias("n_value"))
    kinds = own.groupBy("kind").agg(F.sum("n_value").alias("n_kind"))
    level = F.pow(F.col("n_value") / F.col("n_kind"), F.lit(1 - alpha))
    levels = own.join(F.broadcast(kinds), "kind").select("kind", "value", level.alias("level"))  # four kinds
    shown = pairs.filter(F.col("scenes") >= support)
    known = counts.withColumn("stem", stem)
    known = scratch(known.join(shown.select("stem").distinct(), "stem", "left_semi"), "counts")
    stems = pairs.groupBy("kind", "value", "stem").agg(F.sum("both").alias("both_stem")).join(known.groupBy("stem").agg(F.sum("n").alias("n_stem")), "stem")
    found = shown.join(known.select("term", "n"), "term").join(levels, ["kind", "value"]).filter(F.col("both") / F.col("n") >= F.col("level"))
    found = found.join(stems, ["kind", "value", "stem"])
    vague = (F.length("term") > STEM) & (F.col("both_stem") / F.col("n_stem") < F.col("level"))
    return found.select("kind", "value", "term", F.when(vague, F.concat("stem", F.lit("*"))).alias("general"))


def spans(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(kept, spans): a struct of the columns to keep, and an array of (start, no, end, kind, general) in order of start and kind; null for
    none."""
    scratch = base.Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.struct(*keep).alias("kept"))
    rows = scratch(rows.select(F.monotonically_increasing_id().alias("rid"), "kept", _parts("_text").alias("cut")), "rows")
    found = scratch(entities(rows), "entities")
    near = scratch(terms_near(found), "terms")
    shown = scratch(disclosing(near, term_counts(docs, text), scratch, support=support, alpha=alpha), "disclosing")
    dealt = shown.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = near.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)).cast("int"))
    # A term near two entities goes as far as either asks.
    gone = near.join(dealt, ["kind", "value", "term", "salt"]).groupBy("rid", "start", "end").agg(F.min("general").alias("least"), F.count("general").alias("k"), F.count("*").alias("all"))
    number = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    both = found.select("rid", "start", "end", "kind", F.lit(None).cast("string").alias("general")).union(gone.select("rid", "start", "end", F.lit("term"), F.when(F.col("k") == F.col("all"), F.col("least"))))
    lists = both.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("no"), "end", "kind", "general"))).alias("spans"))
    return rows.select("rid", "kept").join(lists, "rid", "left").select("kept", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The kept columns, how many spans of each kind, all spans and a digest of those of the patterns, as `kind:start:end`."""
    own, none = F.col("spans"), F.col("spans").isNull()
    said = lambda x: F.when(none, "").otherwise(F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","))
    counts = [F.when(none, 0).otherwise(F.expr(f"size(filter(spans, s -> s.kind = '{k}'))")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("kept.*", *counts, F.sha2(said(F.filter(own, lambda s: s["kind"] != "term")).cast("binary"), 256).alias("base_sha256"), said(own).alias("spans"))


def sanitise(docs: DataFrame, *, text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """docs with personal data replaced by its kind, and terms that disclose it by what is left of them. Of spans that overlap the first
    gives the name. Time grows with a text's length times its spans."""
    found = spans(docs, text=text, keep=tuple(docs.columns), support=support, alpha=alpha)
    whole = F.col(f"kept.`{text}`").cast("string")
    name = lambda s: F.when(s["kind"] == "term", F.coalesce(s["general"], F.lit("[removed]"))).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    def put(acc: Column, s: Column) -> Column:
        before = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], before, name(s))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    return found.select(*(F.when(F.col("spans").isNull(), whole).otherwise(clean).alias(c) if c == text else F.col(f"kept.`{c}`") for c in docs.columns))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(base.table(spark, sf_dir, "documents")))


#: The contract's patterns as they are, with positions as running lengths of what lies between matches.
SQL = r"""
WITH kinds(kind, no) AS (VALUES ('email', 1), ('ip', 2), ('card', 3), ('phone', 4)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), chr(1), chr(2)) AS plain FROM documents),
cut AS (SELECT rid, kind, no, string_split(CASE kind {replaced} END, chr(1)) AS parts FROM docs, kinds),
pieces AS (SELECT rid, kind, no, unnest(parts) AS p, unnest(range(len(parts))) AS pos FROM cut WHERE len(parts) > 1),
placed AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY rid, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start", lag(p) OVER w AS before, lead(p) OVER w AS after, regexp_replace(p, '[^0-9]', '', 'g') AS digits FROM pieces WINDOW w AS (PARTITION BY rid, kind ORDER BY pos)),
found AS MATERIALIZED (SELECT rid, kind, no, p AS value, "start", "start" + length(p) AS "end", before, after FROM placed WHERE pos % 2 = 1 AND CASE kind
  WHEN 'ip' THEN list_max(list_transform(string_split(p, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256))) <= 255
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN TRY_CAST(x AS INT) WHEN TRY_CAST(x AS INT) > 4 THEN TRY_CAST(x AS INT) * 2 - 9 ELSE TRY_CAST(x AS INT) * 2 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
sides AS (SELECT f.*, string_split_regex(before, '{space}') AS bw, string_split_regex(after, '{space}') AS aw FROM found f),
lists AS (SELECT *, list_filter(list_transform(bw, lambda x, i: {{'w': x, 'pos': "end" - length(value) - length(before) + coalesce(list_sum(list_transform(bw[:i - 1], lambda y: length(y) + 1)), 0)::BIGINT}}), lambda x: x.w <> '') AS l,
  list_filter(list_transform(aw, lambda x, i: {{'w': x, 'pos': "end" + coalesce(list_sum(list_transform(aw[:i - 1], lambda y: length(y) + 1)), 0)::BIGINT}}), lambda x: x.w <> '') AS r FROM sides),
scenes AS (SELECT rid, kind, value, l[greatest(len(l) - 7, 1):] || r[:8] AS ws FROM lists),
words AS (SELECT rid, kind, value, md5(array_to_string(list_transform(ws, lambda x: x.w), ' ')) AS scene, unnest(ws) AS x FROM scenes),
near AS MATERIALIZED (SELECT rid, kind, value, scene, lower(run) AS term, (pos + instr(w, run) - 1)::BIGINT AS "start", (pos + instr(w, run) - 1 + length(run))::BIGINT AS "end" FROM (SELECT rid, kind, value, scene, x.w AS w, x.pos AS pos, regexp_extract(x.w, '{term}', 1) AS run FROM words) WHERE run <> ''),
pairs AS MATERIALIZED (SELECT kind, value, term, count(*) AS both_n, count(DISTINCT scene) AS scenes, left(term, 4) AS stem FROM near GROUP BY ALL),
own AS (SELECT kind, value, sum(both_n) AS n_value, sum(sum(both_n)) OVER (PARTITION BY kind) AS n_kind FROM pairs GROUP BY kind, value),
levels AS (SELECT kind, value, pow(n_value::DOUBLE / n_kind::DOUBLE, 0.5) AS level FROM own),
counts AS MATERIALIZED (SELECT lower(run) AS term, count(*) AS n FROM (SELECT regexp_extract(unnest(string_split_regex(text, '{space}')), '{term}', 1) AS run FROM docs) WHERE run <> '' GROUP BY 1),
shown AS (SELECT p.kind, p.value, p.term FROM pairs p JOIN counts c USING (term) JOIN levels v ON v.kind = p.kind AND v.value = p.value WHERE scenes >= 2 AND both_n::DOUBLE / n >= level),
gone AS (SELECT DISTINCT rid, 'term' AS kind, 5 AS no, n."start", n."end" FROM near n JOIN shown s ON n.kind = s.kind AND n.value = s.value AND n.term = s.term),
spans AS (SELECT rid, kind, no, "start", "end" FROM found UNION ALL SELECT rid, kind, no, "start", "end" FROM gone),
said AS (SELECT rid, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p, count(*) FILTER (kind = 'term') AS t,
  string_agg(CASE WHEN no < 5 THEN concat(kind, ':', "start", ':', "end") END, ',' ORDER BY "start", no) AS base, string_agg(concat(kind, ':', "start", ':', "end"), ',' ORDER BY "start", no) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, coalesce(t, 0) AS n_term, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN said USING (rid)
"""
#: DuckDB takes patterns as constants only.
_CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": "[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
SQL = SQL.format(replaced=" ".join(f"WHEN '{k}' THEN regexp_replace(plain, '{p}', chr(1) || '\\0' || chr(1), 'g')" for k, p in _CONTRACT.items()), space=r"[ \t\n\x0B\f\r]", term=r"^[^\p{L}@]*(\p{L}{3,})[^\p{L}@]*$")

QUERIES = {"op12_personal_data": op12_personal_data}
ORACLE_SQL = {"op12_personal_data": SQL}
