"""Sinks: JSON documents, JSON lines, SARIF, reports, per-row files with a manifest, provenance."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import first_of, region, sarif_level, severity_rank
from sievework.sources.files import FINDING


#: A document is one row of one task, so the number of its findings is bounded; findings themselves stay a table.
MOST = 200_000


def _at_most(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``rows`` of one aggregate with a count n, or a failure if that is too great."""
    return rows.withColumn("n", F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} {what} in one document")).cast("long")).otherwise(F.col("n"))).where("n >= 0")


def findings_document(findings: DataFrame, key: str = "findings", order: tuple[str, ...] = ("file", "start_line"), most: int = MOST, **meta: str | float) -> DataFrame:
    """One row, one column: the JSON document of all findings in order; refused over ``most``."""
    rows = findings.orderBy(*order).limit(most + 1)
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*order, F.struct(*findings.columns).alias("row")))).alias("rows"))
    parts = [F.lit(v).alias(k) for k, v in meta.items()]
    return _at_most(rows, most, key).select(F.to_json(F.struct(*parts, F.transform("rows", lambda r: r["row"]).alias(key)), {"ignoreNullFields": "false"}).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=not keep_nulls)


def reported(findings: DataFrame) -> DataFrame:
    """Findings that are not said to be no vulnerability: an unknown verdict stays."""
    return findings.where(~F.col("is_vulnerable").eqNullSafe(F.lit(False)))


def headline(findings: DataFrame) -> Column:
    """The first that is said of issue, vulnerability, explanation and rule."""
    return F.coalesce(first_of(*[F.col(n) for n in ("issue", "vulnerability", "explanation", "rule") if n in findings.columns]), F.lit("Possible weakness"))


def narrative(findings: DataFrame) -> Column:
    """The headline, then what is said of the three parts, the explanation if it is none of these, the cross-check and the fix, a paragraph each."""
    said = lambda n: F.nullif(F.trim(F.col(n)), F.lit("")) if n in findings.columns else F.lit(None).cast("string")
    head = headline(findings)
    parts = [F.concat(F.lit(f"{label}: "), said(n)) for label, n in (("What the code is doing", "what_code_does"), ("What could go wrong", "what_could_go_wrong"), ("Vulnerability", "vulnerability"))]
    body = F.concat_ws("\n\n", head, *parts)
    explained = F.when(~F.contains(body, said("explanation")), said("explanation"))
    body = F.concat_ws("\n\n", body, explained)
    crossed = F.when(~F.contains(body, said("cross_check")), said("cross_check"))
    return F.concat_ws("\n\n", body, crossed, F.concat(F.lit("Fix: "), said("fix")))


def sarif_rows(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rules) of a SARIF run as tables. ``findings`` has the columns of FINDING and seq. Rules stand in the order in which
    they were first seen; the first finding with a text describes its rule."""
    rule = F.coalesce(first_of(F.col("rule"), F.col("cwe")), F.lit("finding"))
    r = region(F.col("start_line"), F.col("end_line"), F.col("match_lines"))
    results = reported(findings).select("seq", rule.alias("ruleId"), sarif_level(F.col("severity")).alias("level"), headline(findings).alias("message"), F.regexp_replace("file", r"\\", "/").alias("uri"), r["start_line"].alias("startLine"), r["end_line"].alias("endLine"), "cwe")
    text = F.when(F.col("message") != "Possible weakness", F.col("message"))
    rules = results.groupBy("ruleId").agg(F.min("seq").alias("place"), F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.col("seq"))), F.col("ruleId")).alias("description"), F.min_by("cwe", F.when(F.col("cwe").isNotNull(), F.col("seq"))).alias("cwe"))
    return results, rules


def sarif_document(findings: DataFrame, tool: str = "sievework", most: int = MOST) -> DataFrame:
    """One row: the SARIF 2.1.0 document; refused over ``most`` results."""
    results, rules = sarif_rows(findings)
    location = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct("startLine", "endLine").alias("region")).alias("physicalLocation")))
    listed = results.orderBy("seq").limit(most + 1)
    listed = listed.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", F.struct("ruleId", "level", F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations")).alias("r")))).alias("results"))
    listed = _at_most(listed, most, "results")
    rules = rules.agg(F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("ruleId").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"), F.struct(F.array(F.col("cwe")).alias("tags")).alias("properties")).alias("r")))).alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda x: x["r"]).alias("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.transform("results", lambda x: x["r"]).alias("results"))
    schema = "https://json.schemastore.org/sarif-2.1.0.json"
    return listed.crossJoin(rules).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(schema).alias("$schema"), F.array(run).alias("runs"))).alias("value"))  # one row by one row


def ordered_for_report(findings: DataFrame) -> DataFrame:
    """Most severe first, unknown names last."""
    return findings.orderBy(F.desc(severity_rank(F.col("severity"), -1)), "file", "start_line")


def markdown_report(findings: DataFrame, title: str) -> Iterable[str]:
    """Lines of a report; rows come one by one, so the driver holds no more than one at a time."""
    yield f"# {title}"
    for r in ordered_for_report(findings).toLocalIterator():
        yield f"- **{r['severity'] or '?'}** {r['file']}:{r['start_line']} {r['issue'] or r['rule'] or ''} {r['cwe'] or ''}".rstrip()


def html_report(findings: DataFrame, title: str) -> Iterable[str]:
    safe = lambda x: html.escape("" if x is None else str(x))
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{safe(title)}</title></head><body><h1>{safe(title)}</h1><table>"
    for r in ordered_for_report(findings).toLocalIterator():
        yield "<tr>" + "".join(f"<td>{safe(r[c])}</td>" for c in ("severity", "file", "start_line", "issue", "cwe")) + "</tr>"
    yield "</table></body></html>"


def _steps(walk: list | str | None) -> Iterable[str]:
    if isinstance(walk, str) and walk.strip():
        yield walk.strip()
    for i, step in enumerate(walk if isinstance(walk, list) else (), 1):
        place = ":".join(str(step[k]) for k in ("file", "lines") if step.get(k))
        yield f"{i}. {step.get('explanation') or step.get('text') or ''}" + (f" ({place})" if place else "")
        if step.get("code"):
            yield "```\n" + str(step["code"]).rstrip() + "\n```"


def review_markdown(review: dict) -> Iterable[str]:
    """Lines of one review's report: its header, both walkthroughs (a text or steps), findings with their flags, anchors and what came of them, findings that
    were suppressed and why, and the checklist. A review is one document, so this is the driver's work."""
    yield f"# Review of {review.get('subsystem') or 'the sources'}"
    for label, name in (("Provenance", "provenance"), ("Trust boundary", "trust_boundary"), ("Summary", "summary")):
        if review.get(name):
            yield f"**{label}:** {review[name]}"
    for title, name in (("What the code does", "what_the_code_does"), ("What could go wrong", "what_could_go_wrong")):
        if steps := list(_steps(review.get(name))):
            yield f"## {title}"
            yield from steps
    for f in review.get("findings") or ():
        yield f"## [{f.get('severity') or '?'}] {f.get('title') or f.get('issue') or 'Finding'}"
        yield f"{f.get('file') or '?'}:{f.get('line') or '?'} {f.get('cwe') or ''}".rstrip()
        for name in ("bug_class", "invariant", "failure_mode", "exploitation", "what_to_confirm", "fix"):
            if f.get(name):
                yield f"- {name.replace('_', ' ')}: {f[name]}"
        yield from (f"- flagged: {x}" for x in f.get("flags") or ())
    if review.get("reviewed_anchors"):
        yield "## Anchors"
        yield from (f"- {a.get('anchor')}: {a.get('disposition') or '?'}{' - ' + a['reason'] if a.get('reason') else ''}" for a in review["reviewed_anchors"])
    if review.get("suppressed_findings"):
        yield "## Suppressed"
        yield from (f"- {f.get('title')}: {f.get('suppressed')}" for f in review["suppressed_findings"])
    if review.get("audit_checklist"):
        yield "## Checklist"
        yield from (f"- [ ] {x}" for x in review["audit_checklist"])


def empty_findings(spark: SparkSession) -> DataFrame:
    """What a lane writes that could not run: a valid document without findings."""
    return spark.createDataFrame([], FINDING)


def write_blind_split(rows: DataFrame, path: str, id_col: str, code: str, truth: list[str], split: str) -> None:
    """Code under opaque ids by split, and the truth apart in a manifest: neither a file's name nor its text gives the label away."""
    opaque = F.substring(F.sha2(F.col(id_col).cast("string").cast("binary"), 256), 1, 16)
    rows = rows.withColumn("opaque_id", opaque)
    rows.select("opaque_id", F.col(code).alias("code"), split).write.mode("overwrite").partitionBy(split).parquet(f"{path}/corpus")
    rows.select("opaque_id", id_col, *truth, split, F.sha2(F.col(code).cast("binary"), 256).alias("hash")).write.mode("overwrite").parquet(f"{path}/manifest")


def lane_status(stages: list[tuple[str, bool, bool]], spark: SparkSession) -> DataFrame:
    """(stage, status) of (name, wanted, ran): a stage that should have run and did not has failed, it did not find nothing."""
    rows = spark.createDataFrame(stages, "stage string, wanted boolean, ran boolean")
    return rows.select("stage", F.when(~F.col("wanted"), "skipped").when(F.col("ran"), "ok").otherwise("failed").alias("status"))
