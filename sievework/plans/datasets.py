"""Dataset lane over the driver's tables: digests, splits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import dataset as D
from sievework.plans.registry import query, table

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WS = rf"sha256(trim(regexp_replace(text, '{_SPACE}', ' ', 'g')))"
_SHA8 = "('0x' || substr(sha1({0}), 1, 8))::BIGINT"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    rf"""WITH n AS (SELECT doc_id, sha1(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}$', '')), lambda x: x <> ''), chr(10))) AS digest FROM documents)
SELECT digest, min(doc_id) AS doc_id, count(*) AS n_rows FROM n GROUP BY digest"""
)
def dedup_norm_code(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.sha1(X.drop_blank_lines(F.col("text")).cast("binary")).alias("h"))
    return D.dedup_by_digest(rows, F.col("h"), ["doc_id"]).select("digest", "doc_id", "n_rows")


@query(f"SELECT digest, min(doc_id) AS doc_id, count(*) AS n_rows, count(DISTINCT lang) AS n_labels FROM (SELECT doc_id, lang, {_WS} AS digest FROM documents) GROUP BY digest")
def dedup_norm_ws(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), X.text_digest(F.col("text")).alias("h"))
    return D.dedup_by_digest(rows, F.col("h"), ["doc_id"]).select("digest", "doc_id", "n_rows", "n_labels")


@query(f"SELECT doc_id FROM documents WHERE {_WS} NOT IN (SELECT {_WS} FROM benchmark UNION SELECT {_WS} FROM documents WHERE source = 'src1')")
def leak_anti_join(spark, sf_dir):
    """Documents whose text is neither a benchmark item nor one of source src1, by digest."""
    d = docs(spark, sf_dir).select("doc_id", "source", X.text_digest(F.col("text")).alias("digest"))
    index = table(spark, sf_dir, "benchmark").select(X.text_digest(F.col("text")).alias("digest")).union(d.where("source = 'src1'").select("digest"))
    return D.without_leaks(d, index, "digest").select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {_SHA8.format("source || '::' || text")} % 100 < 20 THEN 'eval' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.when(X.hash_bucket(F.col("source"), F.col("text")) < 20, "eval").otherwise("train").alias("split"))


@query(
    f"""WITH s AS (SELECT {_WS} AS digest, CASE WHEN {_SHA8.format(_WS)} % 100 < 20 THEN 'eval' ELSE 'train' END AS split FROM documents)
SELECT count(*) AS n_rows, count(DISTINCT digest) AS n_keys, (SELECT count(*) FROM (SELECT digest FROM s GROUP BY digest HAVING count(DISTINCT split) > 1)) AS n_shared FROM s"""
)
def split_disjoint(spark, sf_dir):
    """Split by the group's key and not by the row, so that copies never straddle it; counts keys on both sides."""
    rows = docs(spark, sf_dir).select(X.text_digest(F.col("text")).alias("digest")).withColumn("split", F.when(X.hash_bucket(F.col("digest")) < 20, "eval").otherwise("train"))
    by = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("sides"))
    return by.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.when(F.col("sides") > 1, 1).otherwise(0)).alias("n_shared"))


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(text), doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def ratio_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    return D.ratio_split(rows, F.col("h"), ("doc_id",)).select("doc_id", "split")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(doc_id::VARCHAR), doc_id) AS k, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN n > 1 AND k <= least(n - 1, greatest(1, floor(n * 0.1::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def val_split_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id")
    return D.guarded_val_split(rows, F.sha1(F.col("doc_id").cast("string").cast("binary")), ("doc_id",)).select("doc_id", "split")


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha1('42' || doc_id::VARCHAR), doc_id) AS k FROM labels WHERE quality IN (0, 1)) WHERE k <= 10")
def balanced_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return D.balanced(rows, "quality", F.sha1(F.concat(F.lit("42"), F.col("doc_id").cast("string")).cast("binary")), ("doc_id",), 20).select("doc_id", "quality")


@query()
def stratified_round_robin(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return D.stratified(rows, "lang", "quality", ["doc_id"], {1: 60, 0: 30}, 25, ["es", "fr"])


@query()
def budget_pick(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair"), F.col("quality").alias("label"), X.serialized_bytes("doc_id", "text").alias("bytes"))
    return D.budget_pick(rows, F.sha1(F.col("doc_id").cast("string").cast("binary")), ["doc_id"], "bytes", "pair", "label", 80, 120_000)


@query(
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE role WHEN 'user' THEN 1 ELSE 0 END AS label FROM conversations)
SELECT a.conv_id, CAST(a.pos // 2 AS BIGINT) AS pair, a.label = 1 AND b.label = 0 AS well_formed FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.pos % 2 = 0 AND b.pos = a.pos + 1"""
)
def pair_adjacent(spark, sf_dir):
    """Turns 2k and 2k+1 of a conversation as a pair of question and answer."""
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("pos"), F.when(F.col("role") == "user", 1).otherwise(0).alias("label"))
    turns = turns.withColumn("pair", F.floor(F.col("pos") / 2))
    both = turns.groupBy("conv_id", "pair").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("pos") % 2 == 0, F.col("label"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("label"))).alias("b"))
    return both.where("n = 2").select("conv_id", "pair", ((F.col("a") == 1) & (F.col("b") == 0)).alias("well_formed"))


@query(
    """WITH d AS (SELECT doc_id, text AS before, replace(text, '!!', '') AS after, coalesce(quality, 0) AS y FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, sha256(before) AS code_digest, y AS label FROM d UNION ALL SELECT doc_id, sha256(after), 0 FROM d WHERE y = 1 AND trim(after) <> '' AND after <> before"""
)
def twin_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("text").alias("before"), F.replace("text", F.lit("!!"), F.lit("")).alias("after"), F.coalesce("quality", F.lit(0)).alias("y"))
    return D.twin_rows(rows, "before", "after", F.col("y").cast("int")).select("doc_id", F.sha2(F.col("code").cast("binary"), 256).alias("code_digest"), "label")


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, count(DISTINCT source) AS n_groups, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(length(text)) AS longest
FROM documents LEFT JOIN labels USING (doc_id)"""
)
def provenance(spark, sf_dir):
    return D.provenance(docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left"), "text", "quality", "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def project_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def top_classes(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(10)


@query(
    f"""WITH t AS (SELECT CASE WHEN length(text) > 10000 THEN 'long' WHEN length(trim(text)) < 20 THEN 'short' WHEN doc_id <> min(doc_id) OVER (PARTITION BY {_WS}) THEN 'duplicate' ELSE 'kept' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM t GROUP BY reason"""
)
def drop_reasons(spark, sf_dir):
    """Each row by the first rule that drops it, in one pass."""
    rows = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.length(F.trim("text")).alias("solid"), X.text_digest(F.col("text")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    reason = F.when(F.col("n") > 10000, "long").when(F.col("solid") < 20, "short").when(F.col("doc_id") != F.col("first"), "duplicate").otherwise("kept")
    return rows.join(first, "digest").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS digest FROM documents WHERE doc_id % 11 <> 4)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'changed' ELSE 'ok' END AS status FROM a FULL JOIN b ON a.path = b.path"""
)
def manifest_verify(spark, sf_dir):
    """A manifest of digests against a perturbed copy: missing, extra and changed files are all failures."""
    from sievework.sources.files import verify_manifest

    d = docs(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    listed = d.where("doc_id % 10 != 3").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    found = d.where("doc_id % 11 != 4").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return verify_manifest(listed, found)


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256('user: ' || text || chr(10) || 'assistant: ' || next_text) AS digest FROM c WHERE role = 'user' AND next_role = 'assistant' AND trim(text) <> '' AND trim(next_text) <> ''"""
)
def sft_records(spark, sf_dir):
    """Prompt and completion of a question and its answer, both not blank."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    c = c.where("role = 'user' and next_role = 'assistant' and trim(text) != '' and trim(next_text) != ''")
    return c.select("conv_id", "turn", F.sha2(F.concat(F.lit("user: "), "text", F.lit("\nassistant: "), "next_text").cast("binary"), 256).alias("digest"))
