"""Spans of lines: windows, merging, gaps, containment joins, diff lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 64


def lines_of(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line_no from 1, line)."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def line_windows(count: Column, window: int, step: int) -> Column:
    """Array of (start, end) of sliding windows over 0..count, half open: the last is cut at count, and none starts after one that reached it."""
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    used = F.filter(starts, lambda i: (i == 0) | (i - step + window < count))
    return F.transform(used, lambda i: F.struct(i.alias("start"), F.least(count, i + window).alias("end")))


def merge_spans(df: DataFrame, key: list[str], start: str, end: str, score: str, bucket: int = 4096) -> DataFrame:
    """Spans that overlap or touch (start <= end before + 1) become one per key: its start, end, best score and how many it was.

    Spans are sorted within buckets of lines only, and the farthest end and the number of islands are handed on from bucket to bucket by sums of
    one row a bucket, so a file of very many spans is no single task's work."""
    rows = df.withColumn("_bucket", F.floor(F.col(start) / bucket))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key, "_bucket").agg(F.max(end).alias("_end"))
    ends = ends.select(*key, "_bucket", F.max("_end").over(before).alias("_carried"))
    order = Window.partitionBy(*key, "_bucket").orderBy(start, end)
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    rows = rows.join(ends, [*key, "_bucket"]).withColumn("_fresh", fresh)
    rows = rows.withColumn("_local", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*key, "_bucket", "_local").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score), F.count(F.lit(1)).alias("n_spans"), F.max("_fresh").alias("_fresh"))
    counts = parts.groupBy(*key, "_bucket").agg(F.sum("_fresh").alias("_n"))
    counts = counts.select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    parts = parts.join(counts, [*key, "_bucket"]).withColumn("_island", F.col("_offset") + F.col("_local"))
    return parts.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score), F.sum("n_spans").alias("n_spans")).drop("_island")


def with_snippets(spans: DataFrame, lines: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Spans with the text of their lines (``lines``: keys, line_no, line), each line once."""
    asked = spans.select(*key, F.col(start).alias("_start"), F.explode(F.sequence(start, end)).alias("line_no"))
    found = asked.join(lines.select(*key, "line_no", "line"), [*key, "line_no"]).groupBy(*key, F.col("_start").alias(start))
    text = found.agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    return spans.join(text, [*key, start], "left").withColumn("snippet", F.array_join(F.col("_lines.line"), "\n")).drop("_lines")


def gap_spans(lines: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """Runs of lines that ``covered`` (key, line_no) does not name, without blank lines at their edges; blank runs are no gaps."""
    left = lines.join(covered.select(*key, "line_no").distinct(), [*key, "line_no"], "left_anti")
    order = Window.partitionBy(*key).orderBy("line_no")
    left = left.withColumn("_island", F.col("line_no") - F.row_number().over(order))
    solid = F.when(F.trim(F.regexp_replace("line", r"[\t\r\x0B\f]", " ")) != "", F.col("line_no"))
    return left.groupBy(*key, "_island").agg(F.min(solid).alias("start_line"), F.max(solid).alias("end_line")).where("start_line is not null").drop("_island")


def signature_start(lines: DataFrame, key: list[str], boundary: Column, wanted: Column) -> DataFrame:
    """For wanted lines the first line after the last boundary line before them."""
    before = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(boundary, F.col("line_no")), ignorenulls=True).over(before)
    return lines.withColumn("start_line", F.coalesce(last + 1, F.lit(1))).withColumn("_wanted", wanted).where("_wanted").drop("_wanted")


def corroborate(findings: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each finding with the sorted distinct other tools that have a finding in the same file, where one's span holds the
    other's start line, or one of its matched lines is that line. ``findings``: id, tool, file, start_line, end_line and, if it has them, match_lines.

    Spans are dealt into buckets of lines, so that the join is on (file, bucket) and a file with very many findings falls
    apart into many keys; a start line has one bucket, so no pair is found twice from one side.
    """
    rows = findings.select("id", "tool", "file", "start_line", F.greatest(F.coalesce(F.nullif("end_line", F.lit(0)), "start_line"), "start_line").alias("end_line"))
    spans = rows.select("*", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("b"))
    if "match_lines" in findings.columns:
        single = findings.select("id", "tool", "file", F.explode("match_lines").alias("start_line")).withColumn("end_line", F.col("start_line"))
        spans = spans.unionByName(single.withColumn("b", F.floor(F.col("start_line") / bucket)))
    points = rows.select(F.col("id").alias("other_id"), F.col("tool").alias("other_tool"), "file", F.col("start_line").alias("at"), F.floor(F.col("start_line") / bucket).alias("b"))
    hit = spans.join(points, ["file", "b"]).where("tool != other_tool and at between start_line and end_line")
    links = hit.select("id", F.col("other_tool").alias("tool")).union(hit.select("other_id", "tool")).distinct()
    tools = links.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set("tool")).alias("corroborated_by"))
    out = findings.join(tools, findings["id"] == tools["_id"], "left").drop("_id")
    return out.withColumn("corroborated_by", F.coalesce("corroborated_by", F.array().cast("array<string>")))


def corroboration_count(spans: DataFrame, findings: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each span (id, file, start_line, end_line) the number of distinct tools with a finding line inside it, by exact file
    name, and only where no finding has that file name by base name."""
    base = lambda c: F.substring_index(F.regexp_replace(c, r"\\", "/"), "/", -1)
    points = findings.select("file", "tool", F.col("start_line").alias("at")).distinct()
    known = points.select("file").distinct().withColumn("known", F.lit(True))
    asked = spans.join(known, "file", "left").select("*", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("b"))
    points = points.withColumn("b", F.floor(F.col("at") / bucket))
    exact = asked.where("known").join(points, ["file", "b"]).where("at between start_line and end_line").select("id", "tool")
    points = points.select(base(F.col("file")).alias("base"), "tool", "at", "b")
    other = asked.where("known is null").withColumn("base", base(F.col("file"))).join(points, ["base", "b"]).where("at between start_line and end_line").select("id", "tool")
    counts = exact.union(other).groupBy(F.col("id").alias("_id")).agg(F.count_distinct("tool").alias("corroboration"))
    out = spans.join(counts, spans["id"] == counts["_id"], "left").drop("_id")
    return out.withColumn("corroboration", F.coalesce("corroboration", F.lit(0)))


def diff_lines(patches: DataFrame, key: list[str], patch: str) -> DataFrame:
    """(keys, line): the lines of the new side that a unified diff shows, added or as context."""
    lines = lines_of(patches, patch, key)
    header = F.regexp_extract("line", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@", 1)
    order = Window.partitionBy(*key).orderBy("line_no")
    lines = lines.withColumn("from_line", F.nullif(header, F.lit("")).cast("int"))
    lines = lines.withColumn("hunk", F.sum(F.when(F.col("from_line").isNotNull(), 1).otherwise(0)).over(order)).where("hunk > 0")
    new_side = F.col("from_line").isNull() & ~F.col("line").startswith("-") & ~F.col("line").startswith("\\")
    hunk = Window.partitionBy(*key, "hunk").orderBy("line_no")
    lines = lines.withColumn("new_side", new_side).withColumn("line_at", F.first("from_line").over(hunk) + F.sum(F.when(F.col("new_side"), 1).otherwise(0)).over(hunk) - 1)
    # what follows the last line break of the patch is no line of the file
    last = F.max("line_no").over(Window.partitionBy(*key))
    lines = lines.withColumn("last", last)
    return lines.where("new_side and not (line_no = last and line = '')").select(*key, F.col("line_at").cast("int").alias("line"))


def commentable_lines(findings: DataFrame, diff: DataFrame) -> DataFrame:
    """For each finding (id, file, start_line, end_line, match_lines) the first of its matched lines that the diff shows, else
    the first line of its span that it shows, else null."""
    listed = findings.select("id", "file", F.posexplode("match_lines").alias("place", "line")).withColumn("prio", F.lit(0))
    spans = findings.select("id", "file", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line")).select("id", "file", F.col("line").alias("place"), "line", F.lit(1).alias("prio"))
    shown = listed.unionByName(spans).join(diff.select("file", "line").distinct(), ["file", "line"], "left_semi")
    best = shown.groupBy(F.col("id").alias("_id")).agg(F.min_by("line", F.struct("prio", "place")).alias("comment_line"))
    return findings.join(best, findings["id"] == best["_id"], "left").drop("_id")
