"""Records for training and the checks around them: usability, validation, masking, padding, preflight, model choice, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import basename, line_numbers



def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def usable(code: Column, fields: list[Column]) -> Column:
    """Code that is not blank, and at least one field that is not."""
    some = F.lit(False)
    for f in fields:
        some = some | ~blank(f)
    return ~blank(code) & some


def scores_at_least(score: Column, floor: float) -> Column:
    """Not numeric is below any floor."""
    return F.coalesce(score.try_cast("double") >= floor, F.lit(False))


def first_violation(records: DataFrame, seq: str, code: str, fields: list[str]) -> DataFrame:
    """One row: how many records are bad and the first of them; an all-null analysis and one of booleans only are bad."""
    bad = blank(F.col(code)) | F.forall(F.array(*[F.col(f).cast("string") for f in fields]), lambda x: x.isNull() | F.lower(x).isin("true", "false", ""))
    return records.agg(F.coalesce(F.sum(F.when(bad, 1)), F.lit(0)).alias("n_bad"), F.min(F.when(bad, F.col(seq))).alias("first_bad"))


def masked_labels(prompt: Column, completion: Column, ignore: int = -100) -> Column:
    """Labels of prompt + completion tokens: the prompt's are ignored."""
    return F.concat(F.transform(prompt, lambda _: F.lit(ignore)), completion)


def trainable(prompt: Column, completion: Column, longest: int) -> Column:
    """Examples that are too long are dropped and not cut, as are those without a token to learn."""
    return (F.size(prompt) + F.size(completion) <= longest) & (F.size(completion) > 0)


def padded(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), width - F.size(ids))))


def preflight(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(name, level, passed) by rule (name, level, condition), with ok: no required rule has failed. A null condition fails."""
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lv).alias("level"), F.coalesce(F.expr(c), F.lit(False)).alias("passed")) for n, lv, c in rules])
    ok = F.forall(checks, lambda x: (x["level"] != "required") | x["passed"])
    return facts.select(F.explode(checks).alias("c"), ok.alias("ok")).select("c.*", "ok")


def recommend(models: DataFrame, budget_gb: float, context_k: float) -> DataFrame:
    """The strongest model (name, rank, weights_gb, kv_gb_per_k, installed) whose footprint fits; installed ones first, the name decides at last."""
    fits = models.where(F.col("weights_gb") + F.col("kv_gb_per_k") * context_k <= budget_gb)
    return fits.orderBy(F.desc("installed"), F.desc("rank"), "name").limit(1)


def pull_number(ref: Column) -> Column:
    n = F.regexp_extract(ref, r"^refs/pull/([0-9]+)/", 1)
    return F.when(n != "", n.cast("int"))


#: The keys under which an observation may stand, in order.
OBSERVATION_KEYS = ("observation", "note", "text", "description", "detail", "title")


def observation_text(value: Column) -> Column:
    """Text of an observation in JSON: the string itself, or the first of the usual keys that says something, or all `key: value` pairs that do.
    null where nothing is said; what is not JSON is its own text; a null under a key says nothing."""
    v = F.try_parse_json(value)
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = [said(F.try_variant_get(v, f"$.{k}", "string")) for k in OBSERVATION_KEYS]
    pairs = F.filter(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: said(e["value"]).isNotNull())
    joined = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), said(value)).when(kind.startswith("OBJECT"), F.coalesce(*named, said(joined))).otherwise(said(F.try_variant_get(v, "$", "string")))


#: The two walkthroughs of a review.
WALKTHROUGHS = ("what_the_code_does", "what_could_go_wrong")


def review_usable(walkthroughs: list[Column], n_findings: Column) -> Column:
    """Whether a review is worth learning from: a walkthrough, as text or as an array, that is not empty, or a finding."""
    some = F.coalesce(n_findings, F.lit(0)) > 0
    for c in walkthroughs:
        some = some | F.coalesce(F.length(c.cast("string")) > 0, F.lit(False)) & ~F.coalesce(c.cast("string").isin("[]"), F.lit(False))
    return some


def without_transient(reviews: DataFrame) -> DataFrame:
    """A review without the columns that tooling stamps on it."""
    return reviews.drop("_model", "_usage", "_raw", "_source", "_skipped")


#: The fields of an analysis, in the order in which they are learned.
ANALYSIS = ("what_code_does", "what_could_go_wrong", "vulnerability", "is_vulnerable", "issue", "cwe", "severity", "explanation", "fix")


def completion(df: DataFrame) -> Column:
    """The analysis as JSON with all of its fields in fixed order; those that ``df`` has no column for are null."""
    fields = [(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in ANALYSIS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def coverage(forms: DataFrame, steps: DataFrame, ref_steps: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Per review how well its walkthroughs go through the sources: 0.40 for their presence, 0.30 for as many steps as the reference has, 0.30 for the
    share of source lines that are not blank and that steps span.

    ``forms``: keys and, by walkthrough, a column that is `steps` (half of the presence each), `string` (a quarter) or else; ``steps`` and ``ref_steps``:
    keys, section, file, lines; ``sources``: keys, file, line, text. Richness is the mean over both sections of the steps' number by the
    reference's, at most 1, and 1 where the reference has none. Files are known by base name; without source lines nothing is spanned."""
    lines = sources.where(F.trim("text") != "").select(*key, basename(F.col("file")).alias("file"), "line").distinct()
    ends = sources.groupBy(*key, basename(F.col("file")).alias("file")).agg(F.max("line").alias("end"))
    cited = steps.select(*key, basename(F.col("file")).alias("file"), line_numbers(F.col("lines")).alias("nums")).where(F.size("nums") > 0)
    cited = cited.join(ends, [*key, "file"])  # a range may be cited beyond the file's end
    cited = cited.select(*key, "file", F.array_min("nums").alias("low"), F.least(F.array_max("nums"), "end").alias("high")).where("low <= high")
    spanned = cited.select(*key, "file", F.explode(F.sequence("low", "high")).alias("line")).distinct().withColumn("hit", F.lit(1))
    span = lines.join(spanned, [*key, "file", "line"], "left").groupBy(*key).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("span"))
    of = lambda df, name: df.groupBy(*key).agg(*[F.sum(F.when(F.col("section") == w, 1).otherwise(0)).alias(f"{name}_{w}") for w in WALKTHROUGHS])
    out = forms.join(of(steps, "n"), key, "left").join(of(ref_steps, "ref"), key, "left").join(span, key, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    present = sum((F.when(F.col(w) == "steps", 0.5).when(F.col(w) == "string", 0.25).otherwise(0.0) for w in WALKTHROUGHS), F.lit(0.0))
    rich = [F.when(number(f"ref_{w}") == 0, 1.0).otherwise(F.least(F.lit(1.0), number(f"n_{w}") / number(f"ref_{w}"))) for w in WALKTHROUGHS]
    score = present * 0.4 + (rich[0] + rich[1]) / 2 * 0.3 + F.coalesce("span", F.lit(0.0)) * 0.3
    return out.select(*key, present.alias("present"), ((rich[0] + rich[1]) / 2).alias("richness"), F.coalesce("span", F.lit(0.0)).alias("span"), score.alias("score"))


def findings_score(matches: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame:
    """Recall, precision and classification (0.6 CWE, 0.4 severity agreement over matches). ``matches``: keys, same_cwe, same_severity;
    ``totals``: keys, n_ref, n_cand. Without reference findings recall is 1, classification 0 and precision unknown; without matches
    classification is 0."""
    agree = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("same_cwe").cast("double")).alias("cwe"), F.avg(F.col("same_severity").cast("double")).alias("sev"))
    out = totals.join(agree, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.col("n_ref") == 0
    return out.select(
        *key,
        F.when(none, 1.0).otherwise(F.col("n") / F.col("n_ref")).alias("recall"),
        F.when(none, None).when(F.col("n_cand") == 0, 0.0).otherwise(F.col("n") / F.col("n_cand")).alias("precision"),
        F.when(none, 0.0).otherwise(F.coalesce(F.col("cwe") * 0.6 + F.col("sev") * 0.4, F.lit(0.0))).alias("classification"),
    )
