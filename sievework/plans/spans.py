"""Interval lane: events as findings. file = user_id, tool = event_type, a span from the second of ts, value seconds long."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import dataset as D
from sievework.operators import intervals as I
from sievework.operators import metrics as M
from sievework.plans.registry import query, table

E = """WITH e AS (SELECT event_id AS id, event_type AS tool, user_id AS file, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS start_line, CAST(floor(epoch(ts)) AS BIGINT) % 86400 + CAST(floor(value) AS BIGINT) % 600 AS end_line, value FROM events)"""


def findings(spark, sf_dir):
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("user_id").alias("file"), second.alias("start_line"), (second + F.floor("value") % 600).alias("end_line"), "value")


@query(
    E
    + """, r AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_line, end_line, id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT file, min(start_line) AS start_line, max(end_line) AS end_line, max(value) AS value, count(*) AS n_spans FROM i GROUP BY file, island"""
)
def interval_merge(spark, sf_dir):
    return I.merge_spans(findings(spark, sf_dir), ["file"], "start_line", "end_line", "value")


@query(
    E
    + """ SELECT a.id, coalesce(string_agg(DISTINCT b.tool, ',' ORDER BY b.tool), '') AS corroborated_by FROM e a LEFT JOIN e b ON a.file = b.file AND a.tool <> b.tool
 AND (b.start_line BETWEEN a.start_line AND a.end_line OR a.start_line BETWEEN b.start_line AND b.end_line) GROUP BY a.id"""
)
def corroborate(spark, sf_dir):
    return I.corroborate(findings(spark, sf_dir)).select("id", F.array_join("corroborated_by", ",").alias("corroborated_by"))


@query(
    E
    + """, m AS (SELECT * FROM e WHERE tool = (SELECT min(tool) FROM e)), o AS (SELECT * FROM e WHERE tool <> (SELECT min(tool) FROM e))
SELECT m.id, count(DISTINCT o.tool) AS corroboration FROM m LEFT JOIN o ON m.file = o.file AND o.start_line BETWEEN m.start_line AND m.end_line GROUP BY m.id"""
)
def corroboration_count(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("file", F.col("file").cast("string"))
    first = F.broadcast(f.agg(F.min("tool").alias("first_tool")))
    f = f.join(first)
    return I.corroboration_count(f.where("tool = first_tool").select("id", "file", "start_line", "end_line"), f.where("tool != first_tool").select("tool", "file", "start_line")).select("id", "corroboration")


@query(E + " SELECT tool, file, start_line, min(id) AS id FROM e GROUP BY tool, file, start_line")
def tool_dedup(spark, sf_dir):
    return D.first_per_key(findings(spark, sf_dir).select("tool", "file", "start_line", "id"), ["tool", "file", "start_line"], ["id"])


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY event_type")
def tool_counts(spark, sf_dir):
    return M.counts_by(findings(spark, sf_dir).select("tool"), "tool")


@query(E + " SELECT id, greatest(1, start_line)::INTEGER AS start_line, greatest(1, start_line, end_line)::INTEGER AS end_line, least(greatest(1, start_line, end_line), greatest(1, start_line, start_line + 5))::INTEGER AS match_line FROM e")
def region_clamp(spark, sf_dir):
    f = findings(spark, sf_dir)
    whole = X.region(F.col("start_line"), F.col("end_line"), F.lit(None).cast("array<int>"))
    inner = X.region(F.col("start_line"), F.col("end_line"), F.array((F.col("start_line") + 5).cast("int")))
    return f.select("id", whole["start_line"].alias("start_line"), whole["end_line"].alias("end_line"), inner["start_line"].alias("match_line"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


#: Replies around the events' properties, and what state each is in.
_REPLIES = [("concat('{\"message\": {\"content\": ', to_json(named_struct('x', props)), '}}')", "no content"), ("concat('{\"message\": ', props, '}')", "no content"), ("props", "no message"), ("concat('[', props, ']')", "no object"), ("'{\"message\": null}'", "no message"), ("'{\"message\": {\"content\": \"{}\"}}'", "ok"), ("'{\"message\": {\"content\": \"{\"}}'", "unreadable"), ("'cut {'", "no object")]


@query(f"WITH v(i, state) AS (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)})' for i, (_, s) in enumerate(_REPLIES))}) SELECT event_id, state FROM events JOIN v ON (event_id * 3 + length(props)) % {len(_REPLIES)} = i")
def reply_states(spark, sf_dir):
    """Chat replies of all shapes."""
    reply = F.element_at(F.array(*[F.expr(x) for x, _ in _REPLIES]), (F.expr("event_id * 3 + length(props)") % len(_REPLIES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.reply_state(reply).alias("state"))


@query("SELECT event_id, '[' || props || ']' AS repaired FROM events")
def json_repair(spark, sf_dir):
    """Arrays of the properties twice, cut off in the second: the first is kept, and closed."""
    from sievework.functions.lexical import repair_json_udf

    e = table(spark, sf_dir, "events").select("event_id", F.expr("substring(concat('[', props, ',', props, ']'), 1, length(props) + 4)").alias("cut"))
    return e.select("event_id", repair_json_udf("cut").alias("repaired"))


@query(
    """WITH p AS (SELECT page_id, page_id % 7 + 1 AS lo, page_id % 5 + 2 AS n FROM pages) SELECT page_id AS file, CAST(unnest(range(lo, lo + n)) AS INTEGER) AS line FROM p"""
)
def diff_lines(spark, sf_dir):
    """Patches with one context line, added lines and removed ones, and the lines that can be commented on."""
    n = F.col("page_id") % 5 + 2
    at = (F.col("page_id") % 7 + 1).cast("string")
    patch = F.concat(F.lit("--- a\n+++ b\n@@ -"), at, F.lit(",2 +"), at, F.lit(","), n.cast("string"), F.lit(" @@\n context\n-gone\n"), F.array_join(F.array_repeat(F.lit("+new"), (n - 1).cast("int")), "\n"), F.lit("\n\\ No newline at end of file"))
    return I.diff_lines(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), patch.alias("patch")), ["file"], "patch")


@query(
    """WITH p AS (SELECT page_id AS id, page_id % 7 + 1 AS lo, page_id % 5 + 2 AS n, page_id % 11 + 1 AS a FROM pages)
SELECT id, CAST(CASE WHEN a + 2 BETWEEN lo AND lo + n - 1 THEN a + 2 WHEN greatest(a, lo) <= least(a + 3, lo + n - 1) THEN greatest(a, lo) END AS INTEGER) AS comment_line FROM p"""
)
def commentable_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("file"), (F.col("page_id") % 11 + 1).cast("int").alias("start_line"))
    asked = pages.select("id", "file", "start_line", (F.col("start_line") + 3).alias("end_line"), F.array(F.col("start_line") + 2).alias("match_lines"))
    return I.commentable_lines(asked, diff_lines(spark, sf_dir)).select("id", "comment_line")
