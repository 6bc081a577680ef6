"""Findings of several tools and reviews as one table: projections, unions, and the files of a change that they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import graded_confidence, line_numbers, normalize_severity

#: Fields of a classifier's finding that are carried along only where they are there.
OPTIONAL = ("fix", "is_vulnerable", "matched_patterns", "match_lines", "cross_check")


def first_present(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of the named columns that is not null; those that ``df`` doesn't have are passed over."""
    return F.coalesce(*[F.col(f"`{n}`").cast(kind) for n in names if n in df.columns], F.lit(None).cast(kind))


def classifier_findings(findings: DataFrame, tool: str = "ml-classifier") -> DataFrame:
    """A classifier's findings beside those of other tools: the CWE is the rule too, an issue is always said, narratives are empty rather than
    null, and of OPTIONAL the columns that ``findings`` has stay."""
    text = lambda n: F.coalesce(first_present(findings, [n]), F.lit(""))
    issue = F.coalesce(F.nullif(text("issue"), F.lit("")), F.lit("Flagged by vulnerability classifier"))
    kept = [n for n in OPTIONAL if n in findings.columns]
    return findings.select(
        F.lit(tool).alias("tool"), "file", "start_line", "end_line", text("cwe").alias("cwe"), text("cwe").alias("rule"), text("severity").alias("severity"), issue.alias("issue"),
        first_present(findings, ["score"], "double").alias("score"), *[text(n).alias(n) for n in ("what_code_does", "what_could_go_wrong", "vulnerability")], *kept,
    )


def union_findings(*tools: DataFrame) -> DataFrame:
    """All rows of all tools, repeated ones too; a column that a tool lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tools)


def by_place(findings: DataFrame) -> DataFrame:
    """Sorted by file (a null one as the word None) and line (none as 0)."""
    return findings.orderBy(F.coalesce(F.col("file").cast("string"), F.lit("None")), F.coalesce("start_line", F.lit(0)))


def top_scores(findings: DataFrame, k: int, seq: str) -> DataFrame:
    """The k findings of highest score, a missing score as 0 and equals in order of ``seq``; all for a k of 0 or less."""
    ordered = findings.orderBy(F.coalesce("score", F.lit(0.0)).desc(), seq)
    return ordered.limit(k) if k > 0 else ordered


def first_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def to_pipeline(findings: DataFrame) -> DataFrame:
    """A review's findings (file, line, title, cwe, bug_class, severity, where_it_lives, invariant, failure_mode, what_to_confirm, flags array, fix_withheld,
    cve_analog; any may be missing) as findings of the pipeline. A line reference without a number is line 1, without matched lines."""
    said = lambda n: F.coalesce(first_present(findings, [n]), F.lit(""))
    nums = line_numbers(said("line"))
    some = F.size(nums) > 0
    lives, invariant = (F.nullif(F.trim(said(n)), F.lit("")) for n in ("where_it_lives", "invariant"))
    does = F.concat_ws(" ", F.concat(F.lit("Lives in "), lives, F.lit(".")), F.concat(F.lit("Invariant: "), invariant))
    flags = F.when(F.col("flags").isNotNull(), F.size("flags")).otherwise(0) if "flags" in findings.columns else F.lit(0)
    return findings.select(
        said("file").alias("file"), F.when(some, F.array_min(nums)).otherwise(1).alias("start_line"), F.when(some, F.array_max(nums)).otherwise(1).alias("end_line"),
        graded_confidence(said("severity"), flags, said("fix_withheld") != "").alias("score"), said("title").alias("issue"), said("cwe").alias("cwe"), said("bug_class").alias("bug_class"),
        normalize_severity(said("severity")).alias("severity"), does.alias("what_code_does"), said("failure_mode").alias("what_could_go_wrong"),
        F.coalesce(F.nullif(said("bug_class"), F.lit("")), said("title")).alias("vulnerability"), said("what_to_confirm").alias("fix"), F.lit("surface").alias("explainer_backend"),
        F.when(some, nums).alias("match_lines"), F.nullif(said("cve_analog"), F.lit("")).alias("cve_analog"),
    )


def changed_file(findings: DataFrame, changed: DataFrame, key: list[str], file: str = "file") -> DataFrame:
    """``findings`` with the file of the change (``key``, path, ord) that each is about: the one of its own path (without a leading ./), else the first in
    order whose path ends with its own, or the other way round, or has its base name; else its own path. All of these have one
    base name, so it is an equality join; ``found`` says whether the change has the file."""
    own = F.regexp_replace(F.coalesce(F.col(file), F.lit("")), r"^\./", "")
    name = lambda c: F.substring_index(c, "/", -1)
    asked = findings.select(*key, own.alias("_own"), name(own).alias("_name")).distinct()
    paths = changed.select(*key, F.col("path").alias("_path"), name(F.col("path")).alias("_name"), "ord")
    place = F.struct((F.col("_path") != F.col("_own")).alias("other"), F.col("ord"))
    best = asked.join(paths, [*key, "_name"]).groupBy(*key, "_own").agg(F.min_by("_path", place).alias("path"))
    out = findings.withColumn("_own", own).join(best, [*key, "_own"], "left")
    return out.select(*findings.columns, F.coalesce("path", "_own").alias("path"), F.col("path").isNotNull().alias("found"))


def with_sources(reviews: DataFrame, manifest: DataFrame, key: str = "review") -> DataFrame:
    """Reviews joined with the source files that a manifest (review, path) lists for them; one without any keeps a null path."""
    return reviews.join(manifest.select(key, "path"), key, "left")


def source_count(paths: DataFrame, path: str = "path") -> DataFrame:
    """How many distinct files there are."""
    return paths.agg(F.count_distinct(path).alias("n_files"))
