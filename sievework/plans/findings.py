"""Findings of tools and reviews over the driver's tables: projections, unions, gates, and the files of a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import dataset as D
from sievework.operators import findings as P
from sievework.operators import review as R
from sievework.plans.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_CHANGED = "SELECT page_id % 20 AS pull, regexp_extract(url, '//([^?#]*)', 1) || '.c' AS path, page_id AS ord FROM pages"
_ASKED = """SELECT page_id, page_id % 20 AS pull, CASE page_id % 6 WHEN 0 THEN './' || p WHEN 1 THEN p WHEN 2 THEN regexp_extract(p, '[^/]*$', 0) WHEN 3 THEN '/work/' || p WHEN 4 THEN 'other/' || regexp_extract(p, '[^/]*$', 0) ELSE 'nowhere_' || page_id || '.c' END AS file
FROM (SELECT page_id, regexp_extract(url, '//([^?#]*)', 1) || '.c' AS p FROM pages)"""


@query(
    f"""WITH c AS ({_CHANGED}), a AS (SELECT *, regexp_replace(file, '^[.]/', '') AS own FROM ({_ASKED})),
j AS (SELECT a.page_id, c.path, CASE WHEN c.path = a.own THEN 0 ELSE 1 END AS prio, c.ord FROM a JOIN c ON a.pull = c.pull AND (c.path = a.own OR ends_with(c.path, '/' || a.own) OR ends_with(a.own, '/' || c.path) OR regexp_extract(c.path, '[^/]*$', 0) = regexp_extract(a.own, '[^/]*$', 0))),
b AS (SELECT page_id, arg_min(path, prio * 1000000000 + ord) AS path FROM j GROUP BY page_id)
SELECT a.page_id, coalesce(b.path, a.own) AS path, b.path IS NOT NULL AS found FROM a LEFT JOIN b USING (page_id)"""
)
def changed_files(spark, sf_dir):
    """Findings' paths, whole, partial and wrong, among the files of twenty changes."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages_of_changes")
    asked, changed = (spark.sql(x.replace("FROM pages", "FROM pages_of_changes")) for x in (_ASKED, _CHANGED))
    return P.changed_file(asked, changed, ["pull"]).select("page_id", "path", "found")


@query(
    """WITH f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN turn + 3 || '-' || (turn + 9) WHEN 1 THEN 'lines 20, 5' WHEN 2 THEN 'unknown' ELSE '0' END AS line, CASE length(text) % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'blocker' ELSE NULL END AS severity FROM conversations),
n AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(line, '[0-9]+'), lambda x: greatest(1, x::INTEGER)))) AS nums FROM f)
SELECT conv_id, turn, coalesce(nums[1], 1) AS start_line, coalesce(nums[-1], 1) AS end_line, CASE severity WHEN 'High' THEN 'high' WHEN 'blocker' THEN 'critical' ELSE 'medium' END AS severity,
  round(CASE severity WHEN 'High' THEN 0.8::DOUBLE WHEN 'blocker' THEN 0.95 ELSE 0.6 END - 0.2::DOUBLE * (turn % 3) - CASE WHEN turn % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END, 2) AS score, CASE WHEN role = 'user' THEN 'Lives in user. Invariant: n' ELSE 'Invariant: n' END AS what_code_does,
  CASE WHEN turn % 2 = 0 THEN role ELSE text END AS vulnerability, CASE WHEN len(nums) > 0 THEN array_to_string(nums, ',') END AS match_lines FROM n JOIN conversations USING (conv_id, turn)"""
)
def pipeline_findings(spark, sf_dir):
    """Turns as a review's findings, in the pipeline's columns."""
    t = table(spark, sf_dir, "conversations")
    line = F.expr("CASE turn % 4 WHEN 0 THEN concat(turn + 3, '-', turn + 9) WHEN 1 THEN 'lines 20, 5' WHEN 2 THEN 'unknown' ELSE '0' END")
    severity = F.expr("CASE length(text) % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'blocker' END")
    rows = t.select(
        "conv_id", "turn", line.alias("line"), severity.alias("severity"), F.when(F.col("role") == "user", " user ").alias("where_it_lives"), F.lit("n").alias("invariant"), F.col("text").alias("title"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("bug_class"), F.array_repeat(F.lit("x"), (F.col("turn") % 3).cast("int")).alias("flags"), F.when(F.col("turn") % 2 == 0, F.lit("free(p);")).alias("fix_withheld"),
    )
    out = P.to_pipeline(rows.withColumn("file", F.to_json(F.struct("conv_id", "turn"))))
    key = F.from_json("file", "conv_id long, turn long")
    return out.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), "start_line", "end_line", "severity", "score", "what_code_does", "vulnerability", F.array_join(F.col("match_lines").cast("array<string>"), ",").alias("match_lines"))


@query(
    """WITH u AS (SELECT 'ml-classifier' AS tool, user_id % 50 AS file, event_id % 100 AS line, '' AS rule FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, user_id % 50, event_id % 100, 'r' FROM events WHERE event_id % 2 = 1), d AS (SELECT DISTINCT * FROM u)
SELECT tool, count(*) AS n, (SELECT count(*) FROM u) AS n_all FROM d GROUP BY tool"""
)
def union_tools(spark, sf_dir):
    """The events' types as tools, the even events as a classifier's findings; all rows, and after identical ones are dropped."""
    e = table(spark, sf_dir, "events")
    file, line = (F.col("user_id") % 50).cast("string").alias("file"), (F.col("event_id") % 100).cast("int")
    ours = P.classifier_findings(e.where("event_id % 2 = 0").select(file, line.alias("start_line"), line.alias("end_line"), F.col("value").alias("score"), F.lit(True).alias("is_vulnerable")))
    theirs = [e.where((F.col("event_id") % 2 == 1) & (F.col("event_type") == t)).select(F.lit(t).alias("tool"), file, line.alias("start_line"), F.lit("r").alias("rule")) for t in sorted(r[0] for r in e.select("event_type").distinct().collect())]
    rows = P.union_findings(ours, *theirs)
    total = rows.agg(F.count(F.lit(1)).alias("n_all"))
    kept = D.first_per_key(rows.select("tool", "file", "start_line", "rule"), ["tool", "file", "start_line", "rule"], ["tool"])
    return kept.groupBy("tool").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # of one row


_GATE = """WITH f AS (SELECT doc_id, doc_id // 8 AS review, doc_id % 8 AS k, doc_id // 8 % 2 AS odd FROM documents)"""


@query(
    _GATE
    + """ SELECT doc_id, CASE WHEN k = 0 THEN 'key' WHEN k = 1 AND odd = 0 THEN 'ring' END AS suppressed, CASE WHEN k IN (3, 4) THEN 'free(p);' END AS fix_withheld, CASE k WHEN 3 THEN 'release at label' WHEN 4 THEN 'release at label' WHEN 6 THEN 'copied narrative' WHEN 7 THEN 'copied narrative' ELSE '' END AS flags,
CASE k WHEN 5 THEN 'src/a.c' WHEN 2 THEN 'not provided' ELSE 'here' END AS where_it_lives FROM f WHERE (k <> 6 OR doc_id + 1 IN (SELECT doc_id FROM documents)) AND (k <> 7 OR doc_id - 1 IN (SELECT doc_id FROM documents))"""
)
def gated_findings(spark, sf_dir):
    """Eight findings a review: released where the fix tests for an error; released in a branch that does, or in one beside it; an unknown file; two at labels; a
    file that was provided; one narrative twice."""
    gated, complete = _gated(spark, sf_dir)
    return gated.join(complete, "doc_id", "left_semi").select("doc_id", "suppressed", "fix_withheld", F.array_join("flags", ",").alias("flags"), "where_it_lives")


def _gated(spark, sf_dir):
    code = "int f()\n{\n  if (IS_ERR(ring)) {\n    a();\n    b();\n    return 1;\n  } else if (ring == own) {\n    ring = 0;\n  }\nout:\n  return 0;\n}\n"
    k, odd = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 8) % 2
    at = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k + 1).cast("int"))
    line = F.when(k == 1, F.when(odd == 0, "4").otherwise("8")).otherwise(F.lit("11"))
    words = lambda n: " ".join(f"step{i} of {n}" for i in range(12))
    rows = docs(spark, sf_dir).select(
        "doc_id", F.floor(F.col("doc_id") / 8).alias("review"), at("a.c", "src/a.c", "b.c", "a.c", "a.c", "src/a.c", "a.c", "a.c").alias("file"), line.alias("line"),
        at("x", "x", "x", "out:", "x", "x", "x", "x").alias("anchor"),
        at("if (IS_ERR(key)) { ret = PTR_ERR(key); key_put(key); }", "key_put(ring);", "", "free(p);", "free(p);", "", None, "").alias("fix"),
        at("alpha", "beta gamma", "delta", "", None, "epsilon zeta", words("one"), words("one") + ", too").alias("exploitation"),
        at("here", "here", "not provided", "here", "here", "Not provided in the input", "here", "here").alias("where_it_lives"),
    )
    rows = rows.withColumn("fix", F.when(k == 4, "err:\n  free(p);").otherwise(F.col("fix")))
    sources = rows.select("review").distinct().select("review", F.lit("src/a.c").alias("file"), F.lit(code).alias("text"))
    ids = docs(spark, sf_dir).select("doc_id")
    pair = lambda n, other: ids.where(F.col("doc_id") % 8 == n).join(ids.select((F.col("doc_id") + other).alias("doc_id")), "doc_id", "left_semi")
    complete = ids.where("doc_id % 8 < 6").union(pair(6, -1)).union(pair(7, 1))
    gated = R.gate_findings(rows, sources, ["review"], "doc_id")
    return gated.withColumn("fix_withheld", F.regexp_replace("fix_withheld", "^err:\n  ", "")), complete


@query(
    """WITH r AS (SELECT doc_id // 8 AS review, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) = 8), a AS (SELECT doc_id // 8 AS review, count(*) AS anchors, count(*) FILTER (lang = 'de') AS dismissed FROM documents GROUP BY 1)
SELECT review, CASE WHEN review % 2 = 0 THEN 2 ELSE 1 END AS suppressed, 4 AS flagged, 2 AS duplicate_narratives, anchors, dismissed, dismissed = 0 AS all_anchors_became_findings FROM r JOIN a USING (review)"""
)
def validation_counters(spark, sf_dir):
    gated, _ = _gated(spark, sf_dir)
    seen = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 8).alias("review"), F.when(F.col("lang") == "de", "dismissed").otherwise("finding").alias("disposition"))
    whole = gated.groupBy("review").count().where("count = 8").select("review")
    out = R.validation_report(gated, seen, ["review"]).join(whole, "review", "left_semi")
    return out.select("review", *[F.col(c).cast("int").alias(c) for c in ("suppressed", "flagged", "duplicate_narratives")], "anchors", "dismissed", "all_anchors_became_findings")


_CRITIC = """WITH d AS (SELECT doc_id, list_distinct(string_split(lang || ' ' || source, ' ')) AS own, CASE doc_id % 5 WHEN 0 THEN [lang] WHEN 1 THEN [lang, source, 'more'] WHEN 2 THEN ['a', 'b'] WHEN 3 THEN [lang, source, ''] ELSE NULL END AS new, doc_id % 3 AS n, doc_id % 4 AS m FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] ELSE list_filter(own, lambda x: x <> '') END AS own, list_distinct(list_filter(new, lambda x: x <> '')) AS new, n, m FROM d WHERE own IS NOT NULL)"""


@query(_CRITIC + " SELECT doc_id, CASE WHEN new IS NULL THEN false WHEN len(own) = 0 THEN m >= n WHEN len(new) < len(own) THEN false ELSE m >= n OR list_has_all(new, own) END AS ok FROM e")
def critic_gate(spark, sf_dir):
    """Drafts with the document's language and source as anchors, against critiques that leave out, add, replace or lack them."""
    own = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    k = F.col("doc_id") % 5
    new = F.when(k == 0, F.array("lang")).when(k == 1, F.array("lang", "source", F.lit("more"))).when(k == 2, F.array(F.lit("a"), F.lit("b"))).when(k == 3, F.array("lang", "source", F.lit("")))
    rows = docs(spark, sf_dir).where("lang is not null and source is not null")
    return rows.select("doc_id", R.critique_acceptable(own, new, F.col("doc_id") % 3, F.col("doc_id") % 4).alias("ok"))


#: Names of files, and whether only C++ has such.
_FILES = [("a.cpp", True), ("b.HH", True), ("c.h", False), ("d.c", False), ("None", False), (None, False), (" x/y.cxx ", True), (".cpp", False), ("cpp", False), ("z.c++", False)]


@query(f"WITH v(i, ok) AS (VALUES {', '.join(f'({i}, {str(ok).lower()})' for i, (_, ok) in enumerate(_FILES))}) SELECT doc_id, ok FROM documents JOIN v ON (doc_id + length(text)) % {len(_FILES)} = i")
def only_cpp(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n).cast("string") for n, _ in _FILES]), (F.expr("doc_id + length(text)") % len(_FILES) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.only_language(name).alias("ok"))


@query("SELECT doc_id, CASE WHEN (SELECT count(*) FROM documents WHERE lang IS NULL) = 0 THEN lang END AS split, (SELECT count(*) FROM documents WHERE lang IS NULL) = 0 AS declared FROM documents")
def declared_splits(spark, sf_dir):
    """The languages as splits that the rows declare: kept only if every row has one."""
    rows = D.declared_splits(docs(spark, sf_dir), "lang")
    return rows.select("doc_id", F.when(F.col("all_declared"), F.col("lang")).alias("split"), F.col("all_declared").alias("declared"))


@query("SELECT doc_id, round(('0x' || substr(sha1(text), 1, 8))::BIGINT % 1000 / 1000.0, 3)::DOUBLE AS score FROM documents")
def plugged_scores(spark, sf_dir):
    """Scores by a scorer that is loaded once a task and gets batches of texts."""
    from sievework.operators.metrics import score_texts

    def load():
        import hashlib

        return lambda texts: [int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % 1000 / 1000 for t in texts]

    return docs(spark, sf_dir).select("doc_id", F.round(score_texts(F.col("text"), load), 3).alias("score"))


@query("SELECT count(DISTINCT regexp_extract(url, '//([^?#]*)', 1)) AS n_files FROM pages")
def source_count(spark, sf_dir):
    return P.source_count(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^?#]*)", 1).alias("path")))
