"""Training records and their checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import training as T
from sievework.plans.registry import query, table


@query("SELECT count(*) FILTER (trim(text) = '' OR length(text) % 5 = 0) AS n_bad, min(conv_id * 1000 + turn) FILTER (trim(text) = '' OR length(text) % 5 = 0) AS first_bad FROM conversations")
def record_violations(spark, sf_dir):
    """Turns whose analysis (here: null for every fifth length) says nothing."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.when(F.length("text") % 5 != 0, F.col("role")).alias("issue"), F.lit("true").alias("flag"))
    return T.first_violation(rows, "seq", "text", ["issue", "flag"])


@query(
    """WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, CAST(2 AS INTEGER) AS n_ignored, CAST(n AS INTEGER) AS n_learned, CAST(greatest(300, n + 2) AS INTEGER) AS width FROM t WHERE n + 2 <= 800 AND n > 0"""
)
def label_mask(spark, sf_dir):
    """A prompt of two tokens before each turn; label and padding widths of the examples that are kept."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    ids = F.transform(words, lambda x: F.length(x))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.lit(1), F.lit(2)).alias("p"), ids.alias("c")).where(T.trainable(F.col("p"), F.col("c"), 800))
    rows = rows.withColumn("labels", T.masked_labels(F.col("p"), F.col("c")))
    return rows.select("conv_id", "turn", F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_learned"), F.size(T.padded(F.col("labels"), F.lit(300), -100)).alias("width"))


@query("SELECT * FROM (VALUES ('documents', 'required', true, false), ('labels', 'required', true, false), ('many', 'optional', false, false), ('broken', 'required', false, false)) t(name, level, passed, ok)")
def preflight_checks(spark, sf_dir):
    facts = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).join(table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("m")))
    return T.preflight(facts, [("documents", "required", "n > 0"), ("labels", "required", "m > 0"), ("many", "optional", "n > 1000000000"), ("broken", "required", "cast(null as boolean)")])


_FORM = "CASE (doc_id + {0}) % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'string' ELSE 'absent' END"


@query(
    f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
s AS (SELECT doc_id, k, 1 + k * 2 AS low, 2 + k * 2 + doc_id % 4 AS high FROM documents, range(6) t(k) WHERE k < doc_id % 5),
n AS (SELECT doc_id, max(line) AS n_lines FROM l GROUP BY doc_id),
sig AS (SELECT doc_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.doc_id = l.doc_id AND line BETWEEN low AND high)) AS hit FROM l WHERE trim(text) <> '' GROUP BY doc_id),
c AS (SELECT d.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id AND k % 2 = 0) AS n0, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id AND k % 2 = 1) AS n1, doc_id % 3 AS r0, doc_id % 4 AS r1, {_FORM.format(0)} AS f0, {_FORM.format(1)} AS f1 FROM documents d)
SELECT doc_id, round(0.4::DOUBLE * (CASE f0 WHEN 'steps' THEN 0.5 WHEN 'string' THEN 0.25 ELSE 0 END + CASE f1 WHEN 'steps' THEN 0.5 WHEN 'string' THEN 0.25 ELSE 0 END) + 0.15::DOUBLE * (CASE WHEN r0 = 0 THEN 1 ELSE least(1, n0 / r0) END + CASE WHEN r1 = 0 THEN 1 ELSE least(1, n1 / r1) END) + 0.3::DOUBLE * coalesce(hit / n, 0), 6) AS score
FROM c LEFT JOIN sig USING (doc_id)"""
)
def coverage_score(spark, sf_dir):
    """Walkthroughs of up to four steps through each document, against references of up to three."""
    from sievework.operators.intervals import lines_of

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("file"), "text")
    lines = lines_of(docs, "text", ["doc_id", "file"]).select("doc_id", "file", F.col("line_no").alias("line"), F.col("line").alias("text"))
    section = lambda k: F.when(k % 2 == 0, T.WALKTHROUGHS[0]).otherwise(T.WALKTHROUGHS[1])
    steps = docs.select("doc_id", F.substring_index("file", "/", -1).alias("file"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where("k < doc_id % 5")
    cited = F.concat_ws("-", (F.col("k") * 2 + 1).cast("string"), (F.col("k") * 2 + 2 + F.col("doc_id") % 4).cast("string"))
    steps = steps.select("doc_id", section(F.col("k")).alias("section"), "file", cited.alias("lines"))
    ref = docs.select("doc_id", "file", F.explode(F.array(*[F.struct(F.lit(w).alias("section"), (F.col("doc_id") % (3 + i)).alias("n")) for i, w in enumerate(T.WALKTHROUGHS)])).alias("r")).select("doc_id", "file", "r.*")
    ref = ref.where("n > 0").select("doc_id", "section", "file", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")).cast("array<string>")).alias("lines"))
    forms = docs.select("doc_id", *[F.expr(_FORM.format(i)).alias(w) for i, w in enumerate(T.WALKTHROUGHS)])
    return T.coverage(forms, steps, ref, lines, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query(
    """WITH d AS (SELECT source, count(*) FILTER (lang = 'en' AND source <> 'src3') AS n_ref, count(*) FILTER (lang <> 'es') AS n_cand, count(*) FILTER (lang = 'en' AND doc_id % 2 = 0 AND source <> 'src3') AS n,
  count(*) FILTER (lang = 'en' AND doc_id % 2 = 0 AND source <> 'src3' AND doc_id % 3 = 0) AS cwe, count(*) FILTER (lang = 'en' AND doc_id % 2 = 0 AND source <> 'src3' AND doc_id % 5 = 0) AS sev FROM documents GROUP BY source)
SELECT source, round(CASE WHEN n_ref = 0 THEN 1 ELSE n / n_ref END::DOUBLE, 6) AS recall, round(CASE WHEN n_ref = 0 THEN NULL WHEN n_cand = 0 THEN 0 ELSE n / n_cand END::DOUBLE, 6) AS precision, round(CASE WHEN n = 0 THEN 0 ELSE (0.6::DOUBLE * cwe + 0.4::DOUBLE * sev) / n END, 6) AS classification FROM d"""
)
def findings_score(spark, sf_dir):
    """Agreement by source; one source's reference has no findings."""
    d = table(spark, sf_dir, "documents")
    ref = (F.col("lang") == "en") & (F.col("source") != "src3")
    totals = d.groupBy("source").agg(F.sum(F.when(ref, 1).otherwise(0)).alias("n_ref"), F.sum(F.when(F.col("lang") != "es", 1).otherwise(0)).alias("n_cand"))
    matches = d.where(ref & (F.col("doc_id") % 2 == 0)).select("source", (F.col("doc_id") % 3 == 0).alias("same_cwe"), (F.col("doc_id") % 5 == 0).alias("same_severity"))
    out = T.findings_score(matches, totals, ["source"])
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "classification")])


@query("SELECT conv_id, count(*) FILTER (role = 'user' AND length(text) % 2 = 0) > 0 OR count(*) FILTER (role <> 'user' AND length(text) % 3 = 0) > 0 OR min(turn) > 0 AS usable FROM conversations GROUP BY conv_id")
def reviews_usable(spark, sf_dir):
    """Conversations as reviews: the user's texts of even length one walkthrough, others' of lengths by three an array that is the other, the first turn the number of findings."""
    rows = table(spark, sf_dir, "conversations")
    one = F.concat_ws("", F.collect_list(F.when((F.col("role") == "user") & (F.length("text") % 2 == 0), F.lit("x"))))
    other = F.collect_list(F.when((F.col("role") != "user") & (F.length("text") % 3 == 0), F.lit("x")))
    own = rows.groupBy("conv_id").agg(one.alias("a"), other.alias("b"), F.min("turn").alias("n"))
    return own.select("conv_id", T.review_usable([F.col("a"), F.col("b")], F.col("n")).alias("usable"))


@query("SELECT doc_id, sha256('{' || '\"what_code_does\":null,\"what_could_go_wrong\":null,\"vulnerability\":null,\"is_vulnerable\":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'null' END || ',\"issue\":\"' || source || '\",\"cwe\":null,\"severity\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || ',\"explanation\":null,\"fix\":null}') AS digest FROM documents")
def completions(spark, sf_dir):
    """Analyses as JSON of nine fields."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("severity"), F.col("source").alias("issue"), F.when(F.col("doc_id") % 2 == 0, True).alias("is_vulnerable"), F.col("text").alias("other"))
    return rows.select("doc_id", F.sha2(T.completion(rows).cast("binary"), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS INTEGER) END AS number FROM pages")
def pull_numbers(spark, sf_dir):
    ref = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("refs/pull/"), F.col("page_id").cast("string"), F.lit("/merge"))).otherwise(F.lit("refs/heads/main"))
    return table(spark, sf_dir, "pages").select("page_id", T.pull_number(ref).alias("number"))


#: Observations as they are given, and as texts.
_OBSERVED = [
    ('"  plain "', "plain"), ('{"z": 1, "note": " noted"}', "noted"), ('{"text": "t", "note": "n"}', "n"), ('{"title": "x", "detail": "d"}', "d"), ('{"description": "e", "text": "t"}', "t"), ('{"summary": "s", "observation": "o"}', "o"),
    ('{"note": " ", "issue": "i", "b": ""}', "issue: i"), ('{"note": " "}', None), ("5", "5"), ("not json", "not json"), ('""', None), (None, None),
]
_VALUES = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, (_, t) in enumerate(_OBSERVED))


@query(
    f"""WITH v(i, text) AS (VALUES {_VALUES}) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN list_aggregate(list_transform(json_keys(props), lambda k: k || ': ' || (props ->> k)), 'string_agg', '; ') ELSE v.text END AS text FROM events JOIN v ON (event_id // 3) % {len(_OBSERVED)} = i"""
)
def observation_texts(spark, sf_dir):
    """Every third event's own properties, and else the cases above."""
    cases = F.element_at(F.array(*[F.lit(a).cast("string") for a, _ in _OBSERVED]), (F.floor(F.col("event_id") / 3) % len(_OBSERVED) + 1).cast("int"))
    doc = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(cases)
    return table(spark, sf_dir, "events").select("event_id", T.observation_text(doc).alias("text"))


@query("SELECT 'mid' AS name, 2 AS rank")
def recommended_model(spark, sf_dir):
    models = spark.createDataFrame([("big", 3, 40.0, 1.0, True), ("mid", 2, 9.0, 0.25, True), ("new", 3, 8.0, 0.25, False), ("small", 1, 2.0, 0.1, True)], "name string, rank int, weights_gb double, kv_gb_per_k double, installed boolean")
    return T.recommend(models, 12.0, 8.0).select("name", "rank")


@query("SELECT doc_id, trim(text) <> '' AND (coalesce(trim(lang), '') <> '' OR coalesce(trim(source), '') = 'src1') AS usable, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 >= 40 ELSE false END AS over FROM documents")
def usable_records(spark, sf_dir):
    """Documents as records with two fields, one of them mostly blank, and scores that are not always numbers."""
    score = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 100 / 100).cast("string")).when(F.col("doc_id") % 3 == 1, "n/a")
    fields = [F.col("lang"), F.when(F.col("source") == "src1", F.col("source")).otherwise(F.lit(" "))]
    return table(spark, sf_dir, "documents").select("doc_id", T.usable(F.col("text"), fields).alias("usable"), T.scores_at_least(score, 0.4).alias("over"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """The stream's counts by hour, over the table as a batch."""
    from sievework.streaming.scan import hourly_counts as counts

    return counts(table(spark, sf_dir, "events"))
