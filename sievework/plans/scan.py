"""Rule scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import rules as R
from sievework.operators.intervals import lines_of
from sievework.plans.registry import query, table

_RULES = ", ".join(f"({i}, '{r.id}', '{r.cwe}', '{r.severity}', '{r.pattern}', '{r.issue}')" for i, r in enumerate(R.TEXT_RULES))
_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
HITS = f"""WITH rules(ord, rule, cwe, severity, pattern, issue) AS (VALUES {_RULES}),
lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, line_no, line, ord, rule, cwe, severity, issue FROM lines, rules WHERE regexp_matches(line, pattern))"""
PRIMARY = HITS + f""", best AS (SELECT doc_id, line_no, arg_max(rule, {_RANK.format('severity')} * 100 - ord) AS rule, arg_max(cwe, {_RANK.format('severity')} * 100 - ord) AS cwe, arg_max(severity, {_RANK.format('severity')} * 100 - ord) AS severity,
  string_agg(rule, ',' ORDER BY ord) AS rules, string_agg(issue, ' ' ORDER BY ord) AS text FROM hits GROUP BY doc_id, line_no)"""


def hits(spark, sf_dir):
    return R.scan_lines(lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"]))


def primary(spark, sf_dir):
    return R.primary_rules(lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"]), ["doc_id", "line_no"])


@query(HITS + " SELECT doc_id, line_no, rule, cwe, severity FROM hits")
def rule_scan_lines(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "line_no", "rule", "cwe", "severity")


@query(PRIMARY + f" SELECT doc_id, line_no, rule, cwe, severity, rules FROM best WHERE {_RANK.format('severity')} >= 1")
def primary_rule(spark, sf_dir):
    return primary(spark, sf_dir).where(R.at_least(F.col("severity"), "low")).select("doc_id", "line_no", "rule", "cwe", "severity", "rules")


@query(PRIMARY + " SELECT doc_id, line_no, text FROM best")
def rule_text_join(spark, sf_dir):
    return primary(spark, sf_dir).select("doc_id", "line_no", "text")


@query(
    PRIMARY
    + """ SELECT doc_id AS file, line_no AS start_line, line_no AS end_line, rule AS rule_id,
 CASE severity WHEN 'high' THEN 'error' WHEN 'critical' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, text || ' (' || cwe || ')' AS message FROM best"""
)
def sarif_results(spark, sf_dir):
    p = primary(spark, sf_dir)
    r = X.region(F.col("line_no"), F.col("line_no"), F.array("line_no"))
    return p.select(F.col("doc_id").alias("file"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.col("rule").alias("rule_id"), X.sarif_level(F.col("severity")).alias("level"), F.concat("text", F.lit(" ("), "cwe", F.lit(")")).alias("message"))


@query(HITS + ", s AS (SELECT rule, min(doc_id * 100000 + line_no) AS first_seen, count(*) AS n FROM hits GROUP BY rule) SELECT rule, n, row_number() OVER (ORDER BY first_seen, rule) AS place FROM s")
def sarif_rules(spark, sf_dir):
    """Rules of the report in the order in which they were first seen."""
    from pyspark.sql.window import Window

    seen = hits(spark, sf_dir).groupBy("rule").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    return seen.select("rule", "n", F.row_number().over(Window.orderBy("first", "rule")).cast("long").alias("place"))


@query(
    HITS
    + """ SELECT CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS place, severity, count(*) AS n FROM hits GROUP BY severity"""
)
def severity_rollup(spark, sf_dir):
    from sievework.operators.review import severity_counts

    return severity_counts(hits(spark, sf_dir))


@query(
    """WITH k(id, trig) AS (VALUES ('licence', 'licensed under'), ('licence', 'license'), ('contact', 'mail'), ('secret', 'token ='), ('secret', 'api_key'), ('abuse', 'idiot'), ('abuse', 'scum'))
SELECT DISTINCT doc_id, id FROM documents, k WHERE contains(lower(text), trig)"""
)
def kb_match(spark, sf_dir):
    """Knowledge-base entries any of whose triggers stands in the text, case aside: triggers are constants of one expression."""
    kb = [("licence", ["licensed under", "license"]), ("contact", ["mail"]), ("secret", ["token =", "api_key"]), ("abuse", ["idiot", "scum"])]
    low = F.lower("text")
    found = []
    for key, triggers in kb:
        any_of = low.contains(triggers[0])
        for t in triggers[1:]:
            any_of = any_of | low.contains(t)
        found.append(F.when(any_of, F.lit(key)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("ids"))
    return docs.select("doc_id", F.explode("ids").alias("id"))


@query(
    """WITH l AS (SELECT page_id, generate_subscripts(string_split(h, chr(10)), 1) AS line_no, unnest(string_split(h, chr(10))) AS line FROM (SELECT page_id, replace(html, '><', '>' || chr(10) || '<') AS h FROM pages)),
o AS (SELECT *, line_no - row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS island FROM l WHERE NOT regexp_matches(line, '^<(/?(li|ul|nav|a)|script|style)'))
SELECT page_id, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line FROM o WHERE trim(line) <> '' GROUP BY page_id, island"""
)
def gap_spans(spark, sf_dir):
    from sievework.operators.intervals import gap_spans as gaps

    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("h"))
    lines = lines_of(pages, "h", ["page_id"])
    return gaps(lines, lines.where(F.col("line").rlike("^<(/?(li|ul|nav|a)|script|style)")), ["page_id"])


@query(
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(0, n, 6)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS start, CAST(least(n, i + 12) AS INTEGER) AS "end" FROM s WHERE i = 0 OR i - 6 + 12 < n"""
)
def line_windows(spark, sf_dir):
    from sievework.operators.intervals import line_windows as windows

    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return docs.select("doc_id", F.explode(windows(F.col("n"), 12, 6)).alias("w")).select("doc_id", "w.start", "w.end")
