"""URL filters as a temporal list join, in DataFrame functions only.

List entries are dated: an `add` makes a pattern active from its date on, a `remove` ends that. Per list, kind and
pattern they become validity intervals [valid_from, valid_to). A capture is matched by the keys under which an entry can
name it: its host (kind `host`), the host and every parent domain (`domain`), and the host with the prefixes of whole path
segments (`prefix`) of those lengths that some entry has, so a long path costs no more than a short one. An equality join on kind and pattern with the capture's time inside the interval evaluates each capture
against what was active when it was fetched. The intervals are sent to all executors only when counted and few; beyond
that both sides are shuffled by key, where adaptive execution splits the keys of hot hosts.

Edge cases: scheme and host are compared in lower case, `user@`, port, query and fragment are left out, and a leading
`www.` is not special; a null URL, or one without a scheme and host, is never blocked; a capture without a time matches nothing;
of an `add` and a `remove` at one date the `remove` is the later; entries with a null field are left out; repeated entries count
once; repeated captures give repeated results; empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .staging import pick

BROADCAST_ENTRIES = 200_000
ENTRY_SCHEMA = "list string, kind string, pattern string, action string, listed timestamp"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"

#: The lists that the query applies: (list, kind, pattern, action, date).
ENTRIES = [
    ("spam", "host", "spam-farm.example.org", "add", "2023-06-01"),
    ("spam", "domain", "spam.example.net", "add", "2023-06-01"),
    ("spam", "host", "tiontion.example.com", "add", "2024-02-10"),
    ("spam", "host", "tiontion.example.com", "remove", "2024-05-20"),
    ("spam", "host", "tiontion.example.com", "add", "2024-09-01"),
    ("spam", "domain", "thther.example.org", "add", "2024-03-15"),
    ("legal", "prefix", "tionsh.example.net/fr", "add", "2024-01-20"),
    ("legal", "prefix", "tionsh.example.net/fr", "remove", "2024-08-01"),
    ("legal", "domain", "tionsh.example.net", "add", "2024-11-01"),
    ("legal", "prefix", "ththth.example.org/de", "add", "2024-04-04"),
    ("optout", "domain", "ththon.example.com", "add", "2024-06-06"),
    ("optout", "domain", "ththon.example.com", "remove", "2024-07-07"),
    ("optout", "host", "blog.ththly.example.org", "add", "2024-02-02"),
    ("optout", "domain", "tionble.example.com", "add", "2024-10-10"),
    ("optout", "prefix", "ththre.example.org/en", "add", "2024-05-05"),
]


def listed_entries(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    rows = spark.createDataFrame([tuple(map(str, e)) for e in entries], "list string, kind string, pattern string, action string, listed string")
    return rows.withColumn("listed", F.to_timestamp("listed"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): valid_to is null while the entry stands."""
    columns = [f.name for f in T._parse_datatype_string(ENTRY_SCHEMA)]
    rows = pick(entries, **{c: c for c in columns}).dropna().withColumn("pattern", F.lower("pattern")).distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy("listed", "action")
    rows = rows.withColumn("valid_to", F.lead("listed").over(order)).where("action = 'add'")
    return rows.where("valid_to is null or valid_to > listed").select("list", "kind", "pattern", F.col("listed").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per row: the id, url, fetched, blocked, n_active (entries that match and were active) and lists (their names, sorted)."""
    source = pick(captures, page_id=id_col, url=url_col, fetched=time_col)
    intervals = validity_intervals(entries)
    depth = F.size(F.filter(F.split("pattern", "/"), lambda s: s != "")) - 1
    depths = sorted(r[0] for r in intervals.where("kind = 'prefix'").select(depth).distinct().collect())  # a few small numbers
    host = F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")))
    parsed = source.select("page_id", "url", "fetched", host.alias("host"), F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda s: s != "").alias("parts"))
    labels = F.split("host", r"\.")
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    keys = F.concat(
        F.array(key("host", F.col("host"))),
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))),
        F.transform(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: i <= F.size("parts")), lambda i: key("prefix", F.concat_ws("/", F.col("host"), F.array_join(F.slice("parts", 1, i), "/")))),
    )
    if intervals.count() <= BROADCAST_ENTRIES:
        intervals = F.broadcast(intervals)
    named = parsed.where("host is not null and fetched is not null").select("page_id", F.xxhash64("url").alias("u"), "fetched", F.explode(keys).alias("k")).select("page_id", "u", "fetched", "k.kind", F.regexp_replace("k.pattern", "/$", "").alias("pattern"))
    active = named.join(intervals, ["kind", "pattern"]).where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    found = active.groupBy(F.col("page_id").alias("p"), "u", F.col("fetched").alias("f")).agg(F.collect_set(F.struct("list", "kind", "pattern")).alias("entries"))
    out = source.join(found, F.col("page_id").eqNullSafe(F.col("p")) & (F.xxhash64("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
    return out.select(
        F.col("page_id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("fetched").alias(time_col),
        F.col("entries").isNotNull().alias("blocked"),
        F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_active"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("entries.list"))), ","), F.lit("")).alias("lists"),
    )


ORACLE = (
    "WITH e AS (SELECT DISTINCT list, kind, lower(pattern) AS pattern, action, CAST(listed AS TIMESTAMP) AS listed FROM (VALUES "
    + ", ".join(str(e) for e in ENTRIES)
    + r""") AS t(list, kind, pattern, action, listed)),
i AS (SELECT * FROM (SELECT *, lead(listed) OVER (PARTITION BY list, kind, pattern ORDER BY listed, action) AS valid_to FROM e) WHERE action = 'add' AND (valid_to IS NULL OR valid_to > listed)),
c AS (SELECT row_number() OVER () AS rid, page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(page_id % 366 AS INTEGER) AS fetched,
      lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
      list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages),
m AS (SELECT DISTINCT c.rid, i.list, i.kind, i.pattern FROM c, i WHERE c.host <> '' AND c.fetched >= i.listed AND (i.valid_to IS NULL OR c.fetched < i.valid_to) AND (
      (i.kind = 'host' AND c.host = i.pattern) OR (i.kind = 'domain' AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)))
      OR (i.kind = 'prefix' AND starts_with(c.host || '/' || array_to_string(c.parts, '/') || '/', i.pattern || '/')))),
n AS (SELECT rid, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY rid)
SELECT page_id, url, fetched, n.rid IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists FROM c LEFT JOIN n USING (rid)
"""
)
