"""Quality rules with cross-document line frequency, in DataFrame functions only.

Within a text: word and symbol counts, repeated lines, words in repeated three-word windows. Across texts: lines are
normalised (A-Z and other letters lower-cased, digits to 0, white space to one space) and hashed; for each host, the distinct
documents that hold a line are counted, with partial counts before the shuffle. A line is over the limits if it stands in
at least MIN_DOCS documents of the host, and in LINE_SHARE of them or in MANY_DOCS, so that what it takes stops growing with the host; such lines go, and a
text that has less than LEFT_SHARE of its words left is rejected as depleted.

Edge cases: a null text has no words and fails; a null host is the host ''; rows with equal doc_id count once for a line, those
without one as one document;
repeated rows give repeated results; a hash collision (64 bits, within one host) could add to a line's count; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import pick, stage

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
LINE_SHARE = 0.01
MANY_DOCS = 1000
LEFT_SHARE = 0.5
BROADCAST_LINES = 500_000


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three that is found twice or more."""
    none = F.array().cast("array<bigint>")
    grams = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(none)

    def starts(s: Column) -> Column:
        """Of windows sorted by hash, the places of those with an equal neighbour."""
        twice = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        found = F.filter(F.transform(s, lambda x, k: F.when(twice(x, k), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(found)

    def covered(p: Column) -> Column:
        """Words in windows of three that begin at the sorted places ``p``."""
        gains = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gains, F.lit(0), lambda a, b: a + b)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bound(bound(pairs, starts), covered))

    return bound(grams, count)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), SPACE, " ")))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
    n_removed_words, depleted and kept."""
    source = pick(docs, doc_id=id_col, text=text_col, host=host_col)
    source = source.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))

    split = source.select("doc_id", "host", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = split.where(F.length(F.translate("line", SPACES, "")) > 0).select("doc_id", "host", "text_key", "place", line_key(F.col("line")).alias("key"), F.size(words_of(F.col("line"))).cast("long").alias("words"))
    documents = source.groupBy("host").agg(F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("documents"))
    counted = lines.groupBy("host", "key").agg(F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("holders"))
    frequent = counted.where(F.col("holders") >= MIN_DOCS).join(documents, "host").where(F.col("holders") >= F.least(F.col("documents") * LINE_SHARE, F.lit(float(MANY_DOCS)))).select("host", "key")
    frequent = stage(frequent, "frequent")
    few = frequent.count() <= BROADCAST_LINES
    hits = lines.join(F.broadcast(frequent) if few else frequent, ["host", "key"])
    hits = hits.groupBy("doc_id", "host", "text_key", "place").agg(F.max("words").alias("words"))
    removed = hits.groupBy("doc_id", "host", "text_key").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("words").alias("n_removed_words"))

    own_lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    base = source.select(
        "doc_id",
        "host",
        "text_key",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(own_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
    ).select("doc_id", "host", "text_key", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    same = [base[c].eqNullSafe(removed[c]) if c == "doc_id" else base[c] == removed[c] for c in ("doc_id", "host", "text_key")]
    out = base.join(removed, same, "left").select(
        base["doc_id"],
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"),
        F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"),
        F.coalesce("n_removed_words", F.lit(0)).alias("n_removed_words"),
    )
    out = out.withColumn("depleted", F.col("n_words") - F.col("n_removed_words") < F.col("n_words") * LEFT_SHARE)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).withColumnRenamed("doc_id", id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 3)) AS k) GROUP BY rid),
l AS (SELECT rid, doc_id, host, line FROM (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
k AS (SELECT rid, doc_id, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key,
      len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l),
h AS (SELECT host, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS documents FROM d GROUP BY host),
frequent AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS holders FROM k GROUP BY host, key) JOIN h USING (host) WHERE holders >= 20 AND holders >= least(documents * 0.01, 1000)),
gone AS (SELECT rid, count(*) AS n_lines, sum(words) AS n_words FROM k JOIN frequent USING (host, key) GROUP BY rid),
base AS (SELECT d.rid, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      coalesce(gone.n_lines, 0) AS n_removed_lines, CAST(coalesce(gone.n_words, 0) AS BIGINT) AS n_removed_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, n_removed_lines, n_removed_words, n_words - n_removed_words < n_words * 0.5 AS depleted,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND NOT n_words - n_removed_words < n_words * 0.5 AS kept
FROM base
"""
