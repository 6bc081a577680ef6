"""Review lane and normalisers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import review as R
from sievework.plans.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT lang, source, arg_max(doc_id, length(text) * 10000000 - doc_id) AS doc_id, min(doc_id) AS first_seq FROM documents GROUP BY lang, source")
def richest_per_key(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", "source", "doc_id", F.length("text").alias("n"))
    return R.richest_per_key(rows, ["lang", "source"], F.col("n"), "doc_id").select("lang", "source", "doc_id", "first_seq")


_TOPIC_TEXT = "CASE doc_id % 6 WHEN 0 THEN 'The parser may go out of bounds here' WHEN 1 THEN 'Use after free of the node' WHEN 2 THEN 'NULL pointer deref' WHEN 3 THEN 'length exceeds the buffer' WHEN 4 THEN 'checksum is not verified' ELSE 'style only' END"
_TOPIC_CWE = "CASE doc_id % 6 WHEN 0 THEN 'CWE-190' WHEN 1 THEN 'CWE-20' WHEN 2 THEN 'CWE-476' WHEN 3 THEN 'CWE-787' WHEN 4 THEN NULL ELSE 'CWE-1' END"


@query(
    f"""WITH t AS (SELECT doc_id, {_TOPIC_TEXT} AS finding, {_TOPIC_CWE} AS cwe FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'parse-overread' WHEN 1 THEN 'use-after-free' WHEN 2 THEN 'null-deref' WHEN 3 THEN 'length-vs-buffer' WHEN 4 THEN 'checksum' END AS topic,
CASE doc_id % 6 WHEN 0 THEN 'CWE-190' WHEN 1 THEN 'CWE-416' WHEN 2 THEN 'CWE-476' WHEN 3 THEN 'CWE-787' WHEN 4 THEN 'CWE-125' ELSE 'CWE-1' END AS cwe FROM t"""
)
def topic_bucket(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.expr(_TOPIC_TEXT).alias("finding"), F.expr(_TOPIC_CWE).alias("cwe"))
    return rows.select("doc_id", R.topic(F.col("finding")).alias("topic"), R.topic_cwe(F.col("finding"), F.col("cwe")).alias("cwe"))


@query(
    f"""WITH t AS (SELECT doc_id, source, doc_id % 6 AS k, {_TOPIC_TEXT} AS finding FROM documents), b AS (SELECT *, CASE WHEN k < 5 THEN 'topic:' || k ELSE source END AS bucket FROM t) SELECT min(doc_id) AS doc_id, any_value(finding) AS finding FROM b GROUP BY bucket"""
)
def topic_consolidate(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source", F.expr(_TOPIC_TEXT).alias("finding"), F.expr(_TOPIC_CWE).alias("cwe"))
    return R.consolidate_topics(rows, "finding", "cwe", ["source"], "doc_id").select("doc_id", "finding")


@query("SELECT source, coalesce(min(doc_id) FILTER (lang = 'de'), min(doc_id)) AS doc_id FROM documents GROUP BY source")
def anchor_dedup(spark, sf_dir):
    """One row a source: that with the disposition `finding` (here: lang de), else the first."""
    rows = docs(spark, sf_dir).select("source", "doc_id", F.when(F.col("lang") == "de", "finding").otherwise("clean").alias("disposition"))
    return R.anchors(rows, ["source"], "disposition", "doc_id").select("source", "doc_id")


@query("SELECT source, string_agg(DISTINCT (doc_id % 3)::VARCHAR, ',' ORDER BY (doc_id % 3)::VARCHAR) AS samples, count(DISTINCT doc_id % 3) AS n_samples, arg_max(doc_id, length(text) * 10000000 - doc_id) AS doc_id FROM documents GROUP BY source")
def pool_samples(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", "doc_id", (F.col("doc_id") % 3).cast("string").alias("sample"), F.length("text").alias("n"))
    return R.pool_samples(rows, ["source"], F.col("n"), "doc_id").select("source", F.array_join("samples", ",").alias("samples"), "n_samples", "doc_id")


_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_FINDING = """SELECT conv_id, turn AS seq, CASE turn % 3 WHEN 0 THEN './src/' WHEN 1 THEN 'lib/' ELSE '' END || CASE WHEN length(text) % 2 = 0 THEN 'a.c' ELSE 'b.c' END AS file, CAST(turn * 3 AS INTEGER) AS start_line, CAST(turn * 3 + length(text) % 7 AS INTEGER) AS end_line,
  CASE WHEN length(text) % 4 > 0 THEN 'CWE-' || (length(text) % 4) END AS cwe, text AS title, role AS bug_class, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) AS anchor FROM conversations"""
_SIM = f"""WITH f AS ({_FINDING}), t AS (SELECT *, regexp_extract(file, '[^/]*$', 0) AS name, regexp_extract(coalesce(cwe, ''), '[0-9]+', 0) AS number,
  list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, bug_class, anchor)), '[a-z0-9_]+'), lambda x: length(x) > 2 AND x NOT IN ({_quoted(X.STOP_WORDS)}))) AS tok,
  list_filter(regexp_extract_all(lower(anchor || ' ' || title), '[a-z_][a-z0-9_]{{3,}}'), lambda x: x NOT IN ({_quoted(X.GENERIC_ANCHORS)})) AS ids FROM f),
p AS (SELECT a.conv_id, a.seq AS ref_seq, b.seq AS cand_seq, CASE WHEN a.name = b.name AND (a.start_line <= b.end_line AND b.start_line <= a.end_line OR list_has_any(a.ids, b.ids)) THEN 0.6::DOUBLE ELSE 0 END
  + CASE WHEN a.number <> '' AND a.number = b.number THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * coalesce(len(list_intersect(a.tok, b.tok)) / nullif(len(list_distinct(list_concat(a.tok, b.tok))), 0), 0) AS sim FROM t a JOIN t b USING (conv_id) WHERE a.seq % 2 = 0 AND b.seq % 2 = 1)
SELECT conv_id, ref_seq, cand_seq, round(sim, 9) AS sim FROM p WHERE sim >= 0.5"""


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations_of_findings")
    rows = spark.sql(_FINDING.replace("FROM conversations", "FROM conversations_of_findings"))
    return R.similar_pairs(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["conv_id"])


@query(_SIM)
def finding_similarity(spark, sf_dir):
    """Turns of a conversation as findings, the even ones as those of the reference, with all odd ones that may be the same."""
    return _pairs(spark, sf_dir).withColumn("sim", F.round("sim", 9))


@query()
def greedy_match(spark, sf_dir):
    return R.greedy_match(_pairs(spark, sf_dir), ["conv_id"])


@query()
def near_dup_narratives(spark, sf_dir):
    """Near copies of an earlier turn within a conversation, and the turns of which there are some."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.near_duplicates(rows, ["conv_id"], "turn", "text").select("conv_id", "turn", "duplicate_of", "flagged")


_NORM = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))".replace("\\\\", "\\")


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT doc_id, k, CASE k WHEN 0 THEN ls[2:4] WHEN 1 THEN ls[1:3] WHEN 2 THEN ls[1:2] || ['no such line', 'nor this', 'nor that'] WHEN 3 THEN ls[1:1] WHEN 4 THEN []::VARCHAR[] ELSE ls[1:1] END AS code,
  CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 5 THEN 100000 ELSE 1 END AS low, CASE k WHEN 0 THEN 4 WHEN 1 THEN 9 WHEN 5 THEN 100000 ELSE 1 END AS high, len(ls) AS n_lines FROM d, range(6) t(k)),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS at, {_NORM.format("unnest(ls)")} AS line FROM d),
q AS (SELECT doc_id, k, low, high, generate_subscripts(code, 1) AS i, {_NORM.format("unnest(code)")} AS line FROM c),
m AS (SELECT q.doc_id, q.k, q.i, min(greatest(0, q.low - l.at, l.at - q.high)) AS off FROM q LEFT JOIN l ON l.doc_id = q.doc_id AND l.line = q.line WHERE q.line <> '' GROUP BY ALL),
n AS (SELECT doc_id, k, count(*) AS n, count(off) AS found, count(*) FILTER (off <= 2) AS near FROM m GROUP BY ALL),
s AS (SELECT c.doc_id, CASE WHEN k = 3 THEN 'unresolved-file' WHEN n IS NULL THEN 'no-code' WHEN low > n_lines THEN 'out-of-bounds' WHEN found >= 0.75 * n AND near >= 0.6 * found THEN 'grounded' WHEN found >= 0.75 * n THEN 'wrong-line' ELSE 'not-found' END AS state, found / n AS share FROM c LEFT JOIN n USING (doc_id, k))
SELECT doc_id, count(*) AS citations, round(avg(CASE state WHEN 'grounded' THEN share WHEN 'wrong-line' THEN 0.4::DOUBLE * share WHEN 'not-found' THEN 0.3::DOUBLE * share ELSE 0 END), 9) AS score, count(*) FILTER (state = 'grounded') AS grounded, count(*) FILTER (state = 'wrong-line') AS wrong_line,
  count(*) FILTER (state = 'not-found') AS not_found, count(*) FILTER (state = 'out-of-bounds') AS out_of_bounds, count(*) FILTER (state = 'unresolved-file') AS unresolved_file, count(*) FILTER (state = 'no-code') AS no_code FROM s GROUP BY doc_id"""
)
def grounding(spark, sf_dir):
    """Six citations a document: a block at its lines, one elsewhere, one that is mostly made up, another file, nothing, and lines beyond the end."""
    ls = F.split("text", "\n")
    code = F.array(F.slice(ls, 2, 3), F.slice(ls, 1, 3), F.concat(F.slice(ls, 1, 2), F.array(F.lit("no such line"), F.lit("nor this"), F.lit("nor that"))), F.slice(ls, 1, 1), F.array().cast("array<string>"), F.slice(ls, 1, 1))
    lines = F.array(*map(F.lit, ("2-4", "4-9", "1", "1", "1", "100000")))
    own = docs(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), code.alias("codes"))
    cited = own.select("doc_id", "file", F.posexplode("codes").alias("cite", "quoted"))
    name = F.when(F.col("cite") == 3, "nowhere.c").when(F.col("cite") == 2, F.substring_index("file", "/", -1)).when(F.col("cite") == 1, F.concat(F.lit("./"), "file")).otherwise(F.col("file"))
    cited = cited.select("doc_id", "cite", name.alias("file"), F.element_at(lines, F.col("cite") + 1).alias("lines"), F.array_join("quoted", "\n").alias("code"))
    out = R.grounding_score(R.grounding(cited, own.select(F.col("doc_id").alias("seq"), "file", "text"), ["doc_id"]), ["doc_id"])
    return out.withColumn("score", F.round("score", 9))


_PARTS = "doc_id % 11 / 10 AS g, doc_id % 7 / 6 AS c, doc_id % 5 / 4 AS r, doc_id % 3 / 2 AS k"


def _scores(spark, sf_dir):
    part = lambda m: (F.col("doc_id") % m) / F.lit(float(m - 1))
    rows = docs(spark, sf_dir).select("doc_id", "source", part(11).alias("grounding"), part(7).alias("coverage"), part(5).alias("recall"), part(3).alias("classification"))
    return rows.withColumn("composite", R.composite(*[F.col(c) for c in R.COMPONENTS]))


_COMPOSITE = f"SELECT doc_id, source, g, c, r, k, round(40 * g + 25 * c + 20 * r + 15 * k, 1) AS composite FROM (SELECT doc_id, source, {_PARTS} FROM documents)"


@query(f"SELECT doc_id, composite FROM ({_COMPOSITE})")
def composite_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "composite")


@query(f"SELECT source, count(*) AS n_scored, round(avg(composite), 2) AS mean_composite, round(avg(g), 3) AS mean_grounding, round(avg(c), 3) AS mean_coverage, round(avg(r), 3) AS mean_recall, round(avg(k), 3) AS mean_classification FROM ({_COMPOSITE}) GROUP BY source")
def mean_scores(spark, sf_dir):
    return R.mean_scores(_scores(spark, sf_dir), "source")


@query(f"WITH m AS (SELECT source, avg(g) AS g, avg(c) AS c, avg(r) AS r, avg(k) AS k, avg(composite) AS composite FROM ({_COMPOSITE}) GROUP BY source), o AS (SELECT * FROM m WHERE source = 'src0') SELECT m.source, round(m.composite - o.composite, 6) AS composite_less, round(m.g - o.g, 6) AS grounding_less, round(m.k - o.k, 6) AS classification_less FROM m, o WHERE m.source <> 'src0'")
def against_reference(spark, sf_dir):
    """Every source's means beside those of one source."""
    means = _scores(spark, sf_dir).groupBy("source").agg(F.avg("composite").alias("composite"), *[F.avg(c).alias(c) for c in R.COMPONENTS])
    out = R.against_reference(means, "source", "src0")
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("composite_less", "grounding_less", "classification_less")])


@query(f"SELECT doc_id, row_number() OVER (ORDER BY composite DESC, doc_id) AS place FROM ({_COMPOSITE} QUALIFY row_number() OVER (ORDER BY composite DESC, doc_id) <= 20)")
def leaderboard(spark, sf_dir):
    """The twenty best in order."""
    from pyspark.sql.window import Window

    best = R.leaderboard(_scores(spark, sf_dir), "doc_id").limit(20)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("composite"), "doc_id")).cast("long").alias("place"))


@query("WITH f AS (SELECT 'text' AS field, count(*) FILTER (text IS NOT NULL AND trim(text) <> '') AS n_with, count(*) AS n FROM documents UNION ALL SELECT 'quality', count(quality), count(*) FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT *, n_with >= n * 0.5 AS covered FROM f) SELECT *, CASE WHEN (SELECT bool_and(covered) FROM c) THEN 2 ELSE 1 END AS version FROM c")
def schema_coverage(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.schema_coverage(rows, ["text", "quality"])


@query(
    """WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CWE-0079' WHEN 1 THEN 'cwe 22' WHEN 2 THEN '0' WHEN 3 THEN '123456' ELSE '416' END AS c FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-22' WHEN 4 THEN 'CWE-416' END AS cwe, CASE doc_id % 5 WHEN 0 THEN 'CWE-0079' WHEN 1 THEN 'CWE-22' END AS first_cwe FROM v"""
)
def cwe_norm(spark, sf_dir):
    c = F.expr("CASE doc_id % 5 WHEN 0 THEN 'CWE-0079' WHEN 1 THEN 'cwe 22' WHEN 2 THEN '0' WHEN 3 THEN '123456' ELSE '416' END")
    return docs(spark, sf_dir).select("doc_id", X.canonical_cwe(c).alias("cwe"), X.first_cwe(c).alias("first_cwe"))


#: What severities are said to be, and what they must become: the five names, the strict reading, the report's level.
_SAID = [
    ("Critical", "critical", "critical", "error", 0.95), (" HIGH", "high", "high", "warning", 0.8), ("high", "high", "high", "error", 0.8), ("medium", "medium", "medium", "warning", 0.6), ("low", "low", "low", "note", 0.4), ("INFO", "info", "info", "note", 0.25),
    ("moderate", "medium", None, "warning", 0.6), ("important", "high", None, "warning", 0.8), ("severe", "high", None, "warning", 0.8), ("warning", "medium", None, "warning", 0.6), ("informational", "info", None, "note", 0.25), ("note", "info", None, "note", 0.25),
    ("Blocker", "critical", None, "warning", 0.95), ("none", "info", None, "warning", 0.25), ("error", "medium", None, "error", 0.6), ("minor", "medium", None, "warning", 0.6), ("", "medium", None, "warning", 0.6), (None, "medium", None, "warning", 0.6),
    ("style", "medium", None, "note", 0.6), ("performance", "medium", None, "note", 0.6), ("portability", "medium", None, "note", 0.6), ("information", "medium", None, "note", 0.6),
]
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
_rows = lambda values: ", ".join(f"({i}, {', '.join(map(_sql, r))})" for i, r in enumerate(values))


def _said(values, at: int = 0, by: str = "doc_id * 7 + length(text)"):
    """One of the values a row, as varied as its id and text."""
    return F.element_at(F.array(*[F.lit(r[at]).cast("string") for r in values]), (F.expr(by) % len(values) + 1).cast("int"))


@query(
    f"""WITH v(i, said, severity, strict, level, base) AS (VALUES {_rows(_SAID)}) SELECT doc_id, severity, strict, level, round(greatest(0.05::DOUBLE, base - 0.2::DOUBLE * (doc_id % 4) - CASE WHEN doc_id % 5 = 0 THEN 0.1::DOUBLE ELSE 0 END), 2) AS confidence
FROM documents JOIN v ON (doc_id * 7 + length(text)) % {len(_SAID)} = i"""
)
def severity_norm(spark, sf_dir):
    s = _said(_SAID)
    return docs(spark, sf_dir).select("doc_id", X.normalize_severity(s).alias("severity"), X.known_severity(s).alias("strict"), X.sarif_level(s).alias("level"), X.graded_confidence(s, F.col("doc_id") % 4, F.col("doc_id") % 5 == 0).alias("confidence"))


@query(
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id % 50 END AS a, CASE event_id % 7 WHEN 0 THEN NULL ELSE event_id % 90 END AS b, CASE event_id % 3 WHEN 0 THEN []::BIGINT[] ELSE [event_id % 60, event_id % 40 - 1] END AS m FROM events),
s AS (SELECT event_id, a, greatest(coalesce(a, 1), 1) AS low, greatest(coalesce(b, greatest(coalesce(a, 1), 1)), greatest(coalesce(a, 1), 1)) AS high, list_transform(m, lambda x: greatest(x, 1)) AS m FROM r),
t AS (SELECT event_id, CASE WHEN len(m) = 0 THEN low WHEN a IS NULL THEN list_min(m) ELSE least(greatest(list_min(m), low), high) END AS x, CASE WHEN len(m) = 0 THEN high WHEN a IS NULL THEN list_max(m) ELSE least(greatest(list_max(m), low), high) END AS y FROM s)
SELECT event_id, CAST(x AS INTEGER) AS start_line, CAST(greatest(x, y) AS INTEGER) AS end_line FROM t"""
)
def regions(spark, sf_dir):
    """Regions of findings with and without lines of their own and matched lines."""
    e = lambda x: F.expr(x).cast("int")
    matches = F.when(F.expr("event_id % 3 = 0"), F.array().cast("array<int>")).otherwise(F.array(e("event_id % 60"), e("event_id % 40 - 1")))
    r = X.region(e("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id % 50 END"), e("CASE event_id % 7 WHEN 0 THEN NULL ELSE event_id % 90 END"), matches)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all((doc_id % 9)::VARCHAR || '-' || (doc_id % 4)::VARCHAR || ', 7', '[0-9]+'), lambda x: greatest(1, x::INTEGER))))::VARCHAR AS lines FROM documents")
def line_parse(spark, sf_dir):
    ref = F.concat((F.col("doc_id") % 9).cast("string"), F.lit("-"), (F.col("doc_id") % 4).cast("string"), F.lit(", 7"))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("["), F.array_join(X.line_numbers(ref).cast("array<string>"), ", "), F.lit("]")).alias("lines"))


#: What labels and languages are said to be, and what they must become.
_LABELS = [("1", 1), ("TRUE ", 1), ("Yes", 1), ("vul", 1), ("Vulnerable", 1), ("0", 0), ("False", 0), ("no", 0), ("nonvul", 0), ("clean", 0), (" safe", 0), ("7", 7), ("-2", -2), ("positive", 0), ("bad", 0), ("y", 0), ("7.5", 0), ("", 0), (None, None)]
_LANGS = [("C++", "cpp"), ("cpp", "cpp"), (" CXX", "cpp"), ("cc", "cc"), ("h", "h"), ("C", "c"), ("", "c"), (None, "c"), ("Rust", "rust")]


@query(
    f"WITH y(i, said, label) AS (VALUES {_rows(_LABELS)}), g(i, said, lang) AS (VALUES {_rows(_LANGS)}) SELECT doc_id, CAST(label AS INTEGER) AS label, g.lang FROM documents d JOIN y ON (doc_id * 7 + length(text)) % {len(_LABELS)} = y.i JOIN g ON (doc_id + length(text)) % {len(_LANGS)} = g.i"
)
def label_lang_norm(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.normalize_label(_said(_LABELS)).cast("int").alias("label"), X.normalize_language(_said(_LANGS, by="doc_id + length(text)")).alias("lang"))


_ANCHOR = "CASE doc_id % 5 WHEN 0 THEN 'be32_t ' || {w} WHEN 1 THEN {w} || '(struct ' || {w} || ' *m)' WHEN 2 THEN 'int x' WHEN 3 THEN '' ELSE text END"
_WORD = "regexp_extract(text, '[A-Za-z]{4,9}', 0)"


@query(
    f"""WITH a AS (SELECT doc_id, {_ANCHOR.format(w=_WORD)} AS anchor, text AS title FROM documents), t AS (SELECT doc_id, generate_subscripts(x, 1) AS ord, unnest(x) AS tok FROM (SELECT doc_id, list_filter(regexp_extract_all(anchor, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda z: lower(z) NOT IN ({_quoted(X.TYPE_WORDS)})) AS x FROM a)),
l AS (SELECT doc_id, arg_min(tok, -length(tok) * 1000000 + ord) AS tok FROM t GROUP BY doc_id)
SELECT doc_id, left(coalesce(nullif(left(coalesce(lower(tok), trim(regexp_replace(lower(anchor), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), 40), ''), left(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), 24)), 40) AS ident FROM a LEFT JOIN l USING (doc_id)""".replace("\\\\", "\\")
)
def anchor_idents(spark, sf_dir):
    """Which site in code an anchor names."""
    anchor = F.expr(_ANCHOR.format(w=_WORD))
    return docs(spark, sf_dir).select("doc_id", X.anchor_key(F.lit("CWE-1"), anchor, F.col("text"))["ident"].alias("ident"))


@query(
    """WITH l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM conversations),
b AS (SELECT conv_id, turn, string_agg(lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, ' ') || '| ' || line, chr(10) ORDER BY n) AS block FROM l GROUP BY conv_id, turn)
SELECT conv_id, sha256('Files under review: ' || string_agg('t' || turn, ', ' ORDER BY turn) || chr(10) || chr(10) || 'BEGIN SOURCES' || chr(10) || string_agg('/* ===== FILE: t' || turn || ' ===== */' || chr(10) || block, chr(10) || chr(10) ORDER BY turn) || chr(10) || 'END SOURCES') AS digest FROM b GROUP BY conv_id"""
)
def review_contexts(spark, sf_dir):
    """Turns as the files of one review."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), "text")
    return R.review_context(rows, ["conv_id"], "turn").select("conv_id", F.sha2(F.col("context").cast("binary"), 256).alias("digest"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest, regexp_extract(url, '[^/]*$', 0) AS base FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.html_escape(F.col("html")).cast("binary"), 256).alias("digest"), X.basename(F.col("url")).alias("base"))


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sha256(string_agg(lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, ' ') || '| ' || line, chr(10) ORDER BY n)) AS digest FROM l GROUP BY doc_id")
def number_lines(spark, sf_dir):
    """Every line of every document behind its number."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.numbered_lines(F.col("text")).cast("binary"), 256).alias("digest"))


@query("SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS body, count(*) AS n FROM conversations GROUP BY conv_id")
def merged_bodies(spark, sf_dir):
    """Comments at one place as one body, in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("b")).alias("x"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count(F.lit(1)).alias("n"))
    return out.select("conv_id", F.array_join(F.col("xs.b"), "\n").alias("body"), "n")
