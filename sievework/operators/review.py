"""Review findings: richest per key, topics, pooled samples, similarity, greedy matching, composite scores, grounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.lexical import enclosing_condition, similarity_udf
from sievework.functions.text import anchor_identifiers, basename, jaccard, normal_path, severity_rank, tokens

#: Topics in order of priority: (topic, pattern, CWE given, CWEs that may stand). Names, order and CWEs.
TOPICS = [
    ("append-overflow", r"(append|concat|strcat).*(overflow|past the end|out of bounds)", "CWE-787", ("CWE-787", "CWE-191")),
    ("parse-overread", r"(pars|decod|unpack).*(over-?read|past the end|out of bounds)", "CWE-125", ("CWE-125", "CWE-191", "CWE-190")),
    ("use-after-free", r"(use[- ]after[- ]free|freed memory|dangling)", "CWE-416", ("CWE-416",)),
    ("null-deref", r"(null|nullptr).*(deref|pointer)", "CWE-476", ("CWE-476",)),
    ("sign-cast", r"(signed|negative).*(cast|conver|length|size)", "CWE-195", ("CWE-195", "CWE-196")),
    ("dns-label", r"dns.*label", "CWE-125", ("CWE-125",)),
    ("overload-reparse", r"(overload|recurs).*(pars|option)", "CWE-674", ("CWE-674", "CWE-400")),
    ("length-vs-buffer", r"length.*(buffer|capacity)", "CWE-120", ("CWE-120", "CWE-787")),
    ("packed-offset", r"(packed|unaligned).*offset", "CWE-125", ("CWE-125",)),
    ("flexible-array", r"(flexible|trailing) array", "CWE-787", ("CWE-787", "CWE-125")),
    ("validation-gate", r"(validat|sanit|check).*(missing|skipp|bypass|absent)", "CWE-20", ("CWE-20", "CWE-697")),
    ("checksum", r"checksum|crc32", "CWE-125", ("CWE-125",)),
]
#: Shares of the composite score, and credit for a quote that stands elsewhere, or in part.
WEIGHTS = {"grounding": 40, "coverage": 25, "recall": 20, "classification": 15}
ELSEWHERE, IN_PART = 0.40, 0.30


def topic(text: Column) -> Column:
    """The first topic whose pattern stands in the text, or null."""
    low, out = F.lower(text), None
    for name, pattern, _, _ in TOPICS:
        hit = low.rlike("(?s)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def topic_cwe(text: Column, cwe: Column) -> Column:
    """The CWE, or the topic's own if the one given is not among those that the topic allows."""
    found, out = topic(text), None
    for name, _, given, allowed in TOPICS:
        value = F.when(F.coalesce(cwe.isin(*allowed), F.lit(False)), cwe).otherwise(F.lit(given))
        out = F.when(found == name, value) if out is None else out.when(found == name, value)
    return out.otherwise(cwe)


def richest_per_key(df: DataFrame, key: list[str], richness: Column, seq: str) -> DataFrame:
    """Per key the row of greatest richness, the first of equals, with first_seq, the place where the key was first seen."""
    best = F.max_by(F.struct(*df.columns), F.struct(richness, -F.col(seq)))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_row"), F.min(seq).alias("first_seq")).select("_row.*", "first_seq")


def consolidate_topics(df: DataFrame, text: str, cwe: str, fallback: list[str], seq: str) -> DataFrame:
    """One finding a topic, or a fallback key where there is none: the longest text; its CWE made canonical."""
    t = topic(F.col(text))
    rows = df.withColumn("topic", t).withColumn("bucket", F.when(t.isNotNull(), F.concat(F.lit("topic:"), t)).otherwise(F.concat_ws("|", F.lit("key"), *fallback)))
    out = richest_per_key(rows, ["bucket"], F.length(text), seq)
    return out.withColumn(cwe, topic_cwe(F.col(text), F.col(cwe)))


def anchors(df: DataFrame, key: list[str], disposition: str, seq: str, later_finding_wins: bool = False) -> DataFrame:
    """Per anchor the row whose disposition is 'finding', else the first; of several findings the first, or the last when pooling."""
    hit = F.when(F.col(disposition) == "finding", 1).otherwise(0)
    order = F.when(hit == 1, F.col(seq)).otherwise(-F.col(seq)) if later_finding_wins else -F.col(seq)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(F.struct(*df.columns), F.struct(hit, order)).alias("_row")).select("_row.*")


def pool_samples(samples: DataFrame, key: list[str], richness: Column, seq: str) -> DataFrame:
    """Findings of several samples (sample, ...) as one list by key, each with the samples that had it."""
    best = F.max_by(F.struct(*samples.columns), F.struct(richness, -F.col(seq)))
    return samples.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_row"), F.array_sort(F.collect_set("sample")).alias("samples"), F.count_distinct("sample").alias("n_samples")).select("_row.*", "samples", "n_samples")


def _said(p: str, *names: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f"{p}{n}"), F.lit("")) for n in names])


def pool_header(samples: DataFrame, header: list[str], checklist: str, seq: str) -> DataFrame:
    """One row for several samples (sample, ...): the header fields of the first, the distinct entries of all checklists in the order in which they were
    first seen, and the greatest number of findings (n_findings) of one sample."""
    first = samples.agg(F.min_by(F.struct(*header), seq).alias("h"), F.max(F.coalesce("n_findings", F.lit(0))).alias("max_single"))
    entries = samples.select(seq, F.posexplode(checklist).alias("place", "entry")).groupBy("entry").agg(F.min(F.struct(seq, "place")).alias("at"))
    listed = entries.agg(F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("e"))
    return first.crossJoin(listed).select("h.*", F.col("e.entry").alias(checklist), "max_single")  # one row by one row


def review_context(sources: DataFrame, key: list[str], seq: str, begin: str = "BEGIN SOURCES", end: str = "END SOURCES") -> DataFrame:
    """Per review one text: the files' names, then each file (path, text) in order with its lines numbered, between two markers."""
    from sievework.functions.text import numbered_lines

    block = F.concat(F.lit("/* ===== FILE: "), F.col("path"), F.lit(" ===== */\n"), numbered_lines(F.col("text")))
    rows = sources.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(seq, "path", block.alias("block")))).alias("files"))
    names, blocks = F.array_join(F.col("files.path"), ", "), F.array_join(F.col("files.block"), "\n\n")
    return rows.select(*key, F.concat(F.lit("Files under review: "), names, F.lit(f"\n\n{begin}\n"), blocks, F.lit(f"\n{end}")).alias("context"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(place, severity, n): the five names from the most severe, then others by name; a missing one is `?`."""
    name = F.lower(F.coalesce(F.nullif("severity", F.lit("")), F.lit("?")))
    rank = severity_rank(F.col("severity"), -1)
    return findings.select(name.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select((F.lit(4) - rank).alias("place"), "severity", "n")


def similarity(a: str, b: str) -> Column:
    """0.6 for an overlap of lines or a shared identifier in files of one name, 0.2 for the same CWE number, 0.2 times the Jaccard of words.
    ``a`` and ``b`` are prefixes of columns file, start_line, end_line, cwe, title, bug_class and anchor. An empty file is no file."""
    c = lambda p, n: F.col(f"{p}{n}")
    name = lambda p: basename(F.coalesce(c(p, "file"), F.lit("")))
    same_file = (name(a) == name(b)) & (F.coalesce(c(a, "file"), F.lit("")) != "")
    overlap = F.coalesce((c(a, "start_line") <= c(b, "end_line")) & (c(b, "start_line") <= c(a, "end_line")), F.lit(False))
    shared = F.arrays_overlap(anchor_identifiers(_said(a, "anchor", "title")), anchor_identifiers(_said(b, "anchor", "title")))
    number = lambda p: F.regexp_extract(F.coalesce(c(p, "cwe"), F.lit("")), "[0-9]+", 0)
    words = lambda p: tokens(_said(p, "title", "bug_class", "anchor"))
    same_cwe = (number(a) != "") & (number(a) == number(b))
    return F.when(same_file & (overlap | shared), 0.6).otherwise(0.0) + F.when(same_cwe, 0.2).otherwise(0.0) + F.lit(0.2) * jaccard(words(a), words(b))


def similar_pairs(refs: DataFrame, cands: DataFrame, group: list[str], threshold: float = 0.5, bucket: int = 64) -> DataFrame:
    """(group, ref_seq, cand_seq, sim) of all pairs of a group at or over the threshold, which must be over 0.4: such pairs share a file's name
    and an identifier or lines, so they meet in a join on these and no other pairs are made. Both sides have group, seq and the columns of
    ``similarity``."""
    if threshold <= 0.4:
        raise ValueError("pairs that share neither an identifier nor lines reach 0.4")
    names = ["seq", "file", "start_line", "end_line", "cwe", "title", "bug_class", "anchor"]

    def keyed(df: DataFrame, p: str) -> DataFrame:
        low, high = (F.floor(F.col(f"{p}{n}") / bucket) for n in ("start_line", "end_line"))
        at = F.when(F.col(f"{p}start_line") <= F.col(f"{p}end_line"), F.transform(F.sequence(low, high), lambda x: F.concat(F.lit("#"), x.cast("string"))))
        marks = F.concat(anchor_identifiers(_said(p, "anchor", "title")), F.coalesce(at, F.array().cast("array<string>")))
        df = df.select(*group, *[F.col(n).alias(f"{p}{n}") for n in names])
        return df.where(F.coalesce(F.col(f"{p}file"), F.lit("")) != "").withColumn("name", basename(F.col(f"{p}file"))).withColumn("mark", F.explode(marks))

    met = keyed(refs, "a_").select(*group, "name", "mark", "a_seq").join(keyed(cands, "b_").select(*group, "name", "mark", "b_seq"), [*group, "name", "mark"]).select(*group, "a_seq", "b_seq").distinct()
    side = lambda df, p: df.select(*group, *[F.col(n).alias(f"{p}{n}") for n in names])
    pairs = met.join(side(refs, "a_"), [*group, "a_seq"]).join(side(cands, "b_"), [*group, "b_seq"])
    return pairs.select(*group, F.col("a_seq").alias("ref_seq"), F.col("b_seq").alias("cand_seq"), similarity("a_", "b_").alias("sim")).where(F.col("sim") >= threshold)


def greedy_match(pairs: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """One to one, per group: references in order of ref_seq take the most similar free candidate at or over the threshold, the first of
    equals by cand_seq. ``pairs``: group, ref_seq, cand_seq, sim. Only pairs over the threshold reach the fold, a group a task."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in (*group, "ref_seq", "cand_seq", "sim")]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ref_seq", "sim", "cand_seq"], ascending=[True, False, True], kind="stable")
        used, done, keep = set(), set(), []
        for ref, cand in zip(pdf.ref_seq, pdf.cand_seq, strict=True):
            take = ref not in done and cand not in used
            if take:
                done.add(ref)
                used.add(cand)
            keep.append(take)
        return pdf[keep]

    return pairs.where(F.col("sim") >= threshold).select(*group, "ref_seq", "cand_seq", "sim").groupBy(*group).applyInPandas(fold, ", ".join(columns))


def near_duplicates(df: DataFrame, group: list[str], seq: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``df`` with duplicate_of, the first earlier row of the group of which a row is a near copy, and flagged: it is one, or it is the
    first of which another is one. Near is the share of matching blocks of the whole texts, in lower case and with what is neither a-z, 0-9 nor a
    space made spaces; a text that is blank then is near nothing.

    Equal texts of a group are one; distinct ones are compared in pairs whose lengths allow the threshold, by a join on group and
    class of length that many tasks share."""
    norm = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9 ]+", " ")
    rows = df.withColumn("_norm", norm)
    distinct = rows.where(F.trim("_norm") != "").groupBy(*group, "_norm").agg(F.min(seq).alias("_first"))
    ratio = threshold / (2 - threshold)  # of the shorter to the longer, at least
    size = F.floor(F.log(F.length("_norm").cast("double")) / F.log(F.lit(1 / ratio))).cast("int")
    a = distinct.select(*group, F.col("_norm").alias("_a"), F.col("_first").alias("_of"), F.explode(F.array(size - 1, size, size + 1)).alias("_size"))
    b = distinct.select(*group, "_norm", "_first", size.alias("_size"))
    fits = (F.col("_of") < F.col("_first")) & (F.least(F.length("_a"), F.length("_norm")) >= F.greatest(F.length("_a"), F.length("_norm")) * ratio - 1e-6)
    pairs = a.join(b, [*group, "_size"]).where(fits)
    near = pairs.withColumn("_near", similarity_udf(threshold)("_a", "_norm")).where("_near")
    earlier = near.groupBy(*group, "_norm").agg(F.min("_of").alias("_of"))
    out = rows.join(distinct, [*group, "_norm"], "left").join(earlier, [*group, "_norm"], "left")
    # copies of the same text follow its first row; the first row itself follows an earlier near copy
    of = F.when(F.col("_first") < F.col(seq), F.least("_first", "_of")).otherwise(F.col("_of"))
    out = out.withColumn("duplicate_of", of)
    named = out.where("duplicate_of is not null").select(*group, F.col("duplicate_of").alias(seq)).distinct().withColumn("_named", F.lit(True))
    return out.join(named, [*group, seq], "left").select(*df.columns, "duplicate_of", (F.col("duplicate_of").isNotNull() | F.col("_named").isNotNull()).alias("flagged"))


def composite(grounding: Column, coverage: Column, recall: Column, classification: Column) -> Column:
    """0 to 100, to one place; a component that is null counts as 0."""
    parts = zip((grounding, coverage, recall, classification), WEIGHTS.values(), strict=True)
    first, *rest = (F.coalesce(p, F.lit(0.0)) * float(w) for p, w in parts)
    for part in rest:
        first = first + part
    return F.round(first, 1)


COMPONENTS = ("grounding", "coverage", "recall", "classification")


def mean_scores(scores: DataFrame, model: str) -> DataFrame:
    """Per model how many reviews were scored, the mean composite to two places and the mean components to three."""
    return scores.groupBy(model).agg(F.count(F.lit(1)).alias("n_scored"), F.round(F.avg("composite"), 2).alias("mean_composite"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in COMPONENTS])


def leaderboard(scores: DataFrame, name: str) -> DataFrame:
    """Reviews of one reference by composite, the best first and equals by name. Sorted, not ranked, so no task holds all rows."""
    return scores.orderBy(F.desc("composite"), name)


def against_reference(scores: DataFrame, key: str, reference: str) -> DataFrame:
    """Every review beside the one that is the reference: the columns of ``COMPONENTS`` and composite, less the reference's."""
    own = scores.where(F.col(key) == reference).select(*[F.col(c).alias(f"ref_{c}") for c in ("composite", *COMPONENTS)]).limit(1)
    rows = scores.where(F.col(key) != reference).crossJoin(F.broadcast(own))  # of one row
    return rows.select(key, *[(F.col(c) - F.col(f"ref_{c}")).alias(f"{c}_less") for c in ("composite", *COMPONENTS)])


def _one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def grounding(citations: DataFrame, sources: DataFrame, key: list[str], tolerance: int = 2) -> DataFrame:
    """Per citation (``key``, cite, file, lines, code) its state and credit, 0 to 1, against the sources (seq, file, text).

    The lines of the quoted code that are not blank, white space aside, are looked up in the file; the first and last number in ``lines``
    is the cited range. States, the first that holds: unresolved-file; no-code, if nothing is quoted or no line cited; out-of-bounds, if the range begins
    behind the file's end; grounded, if three quarters of the quoted lines stand in the file and three fifths of those within
    ``tolerance`` lines of the range, with the share found as credit; wrong-line, if only the first holds, at ELSEWHERE of it; not-found, with
    IN_PART of it. A file is known by its path, its normal path or its base name, in this order, of equals the last."""
    aliases = lambda c: F.array(*[F.struct(F.lit(i).alias("prio"), x.alias("alias")) for i, x in enumerate((c, normal_path(c), basename(c)))])
    named = sources.select("seq", F.explode(F.array_distinct(F.transform(aliases(F.col("file")), lambda x: x["alias"]))).alias("alias")).groupBy("alias").agg(F.max("seq").alias("seq"))
    from sievework.functions.text import line_numbers

    cited = citations.select(*key, "cite", "file", line_numbers(F.col("lines")).alias("nums"), F.filter(F.transform(F.split(F.coalesce("code", F.lit("")), "\r\n|[\n\r]"), _one_space), lambda x: x != "").alias("quoted"))
    asked = cited.select(*key, "cite", F.explode_outer(F.when(F.coalesce("file", F.lit("")) != "", aliases(F.col("file")))).alias("a")).select(*key, "cite", "a.*")
    found = asked.join(named, "alias", "left").groupBy(*key, "cite").agg(F.min_by("seq", F.when(F.col("seq").isNotNull(), F.col("prio"))).alias("seq"))
    text = F.split(F.regexp_replace("text", "(\r\n|[\n\r])\\z", ""), "\r\n|[\n\r]")
    lines = sources.select("seq", F.when(F.col("text") == "", 0).otherwise(F.size(text)).alias("n_lines"))
    cited = cited.join(found, [*key, "cite"]).join(lines, "seq", "left")
    low, high = F.element_at("nums", 1), F.element_at("nums", -1)
    checked = (F.col("n_lines").isNotNull()) & (F.size("quoted") > 0) & (F.size("nums") > 0) & (F.try_element_at("nums", F.lit(1)) <= F.col("n_lines"))
    quotes = cited.where(checked).select(*key, "cite", "seq", low.alias("low"), high.alias("high"), F.posexplode("quoted").alias("q", "line"))
    at = sources.select("seq", F.posexplode(text).alias("p", "line")).select("seq", _one_space(F.col("line")).alias("line"), (F.col("p") + 1).alias("at")).where("line != ''")
    off = F.greatest(F.lit(0), F.col("low") - F.col("at"), F.col("at") - F.col("high"))
    met = quotes.join(at, ["seq", "line"], "left").groupBy(*key, "cite", "q").agg(F.min(off).alias("off"))
    met = met.groupBy(*key, "cite").agg(F.count(F.lit(1)).alias("n"), F.count("off").alias("n_found"), F.sum(F.when(F.col("off") <= tolerance, 1).otherwise(0)).alias("n_near"))
    share = F.col("n_found") / F.col("n")
    near = F.col("n_near") >= F.col("n_found") * 0.6
    state = (
        F.when(F.col("n_lines").isNull(), "unresolved-file").when((F.size("quoted") == 0) | (F.size("nums") == 0), "no-code").when(F.col("n").isNull(), "out-of-bounds")
        .when((share >= 0.75) & near, "grounded").when(share >= 0.75, "wrong-line").otherwise("not-found")
    )
    credit = F.when(F.col("state") == "grounded", share).when(F.col("state") == "wrong-line", share * ELSEWHERE).when(F.col("state") == "not-found", share * IN_PART).otherwise(0.0)
    return cited.join(met, [*key, "cite"], "left").withColumn("state", state).select(*key, "cite", "state", credit.alias("credit"))


STATES = ("grounded", "wrong-line", "not-found", "out-of-bounds", "unresolved-file", "no-code")


def grounding_score(cited: DataFrame, key: list[str]) -> DataFrame:
    """Per review the mean credit, how many citations there are and how many in each state."""
    count = [F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s.replace("-", "_")) for s in STATES]
    return cited.groupBy(*key).agg(F.avg("credit").alias("score"), F.count(F.lit(1)).alias("citations"), *count)


def critique_acceptable(draft: Column, critique: Column, n_draft: Column, n_critique: Column) -> Column:
    """Whether a critique may replace a draft. ``draft`` and ``critique`` are the identifiers of the anchors that each went through (empty ones
    don't count), the numbers those of findings; a null critique is none. A draft without anchors says nothing about coverage, so then the critique needs as many
    findings. Else it needs as many anchors, and as many findings or every anchor of the draft."""
    named = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))
    own, new = named(draft), named(critique)
    enough = F.coalesce(n_critique, F.lit(0)) >= F.coalesce(n_draft, F.lit(0))
    covers = (F.size(new) >= F.size(own)) & (enough | (F.size(F.array_except(own, new)) == 0))
    return critique.isNotNull() & F.when(F.size(own) == 0, enough).otherwise(covers)


def schema_coverage(docs: DataFrame, fields: list[str], share: float = 0.5) -> DataFrame:
    """(field, n_with, n, covered, version): how many documents say something in each field, and version 2 if every field is covered, else 1. No documents cover
    nothing."""
    counts = docs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1).otherwise(0)).alias(f) for f in fields])
    covered = lambda f: (F.col("n") > 0) & (F.coalesce(F.col(f), F.lit(0)) >= F.col("n") * share)
    all_of = covered(fields[0])
    for f in fields[1:]:
        all_of = all_of & covered(f)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0)).alias("n_with"), F.col("n"), covered(f).alias("covered")) for f in fields])
    return counts.select(F.explode(rows).alias("s"), F.when(all_of, 2).otherwise(1).alias("version")).select("s.*", "version")


#: What tests a variable for holding an error, and what releases one.
ERROR_POINTER = r"\b(?:IS_ERR(?:_OR_NULL)?|PTR_ERR)\s*\(\s*&?\s*([A-Za-z_]\w*)"
RELEASE = r"\b(?:[A-Za-z_]\w*_put|put_[A-Za-z_]\w*|k?free|kzfree|vfree|kfree_sensitive)\s*\(\s*&?\s*([A-Za-z_]\w*)"
LABEL = r"(?:^|\n)\s*[A-Za-z_]\w*\s*:\s*(?:$|\n|//|/\*)"


def gate_findings(findings: DataFrame, sources: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Findings (``key``, ``seq``, file, line, anchor, fix, exploitation, where_it_lives) checked against the sources (``key``, file, text).

    suppressed: the variable that the fix releases, if the fix itself or the condition of the innermost block around the first cited line tests it
    for an error; the finding stays, marked. flags: `release at label`, a release in a fix at a label, which is then withheld (in fix_withheld); `copied
    narrative`, an exploitation that is a near copy of another one's of the same review (suppressed findings aside). where_it_lives becomes the file's name
    if it says `not provided` of a file that was."""
    from sievework.functions.text import line_numbers

    base = lambda c: basename(F.coalesce(c, F.lit("")))
    fix, anchor = F.coalesce("fix", F.lit("")), F.coalesce("anchor", F.lit(""))
    found = lambda c, pattern: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    rows = findings.withColumn("_name", base(F.trim("file"))).withColumn("_at", F.array_min(line_numbers(F.col("line"))))
    named = sources.select(*key, base(F.col("file")).alias("_name"), F.col("text").alias("_text")).groupBy(*key, "_name").agg(F.max("_text").alias("_text"))
    rows = rows.join(named, [*key, "_name"], "left")
    released = found(fix, RELEASE)
    inside = F.array_intersect(found(fix, ERROR_POINTER), released)
    look = (F.size(inside) == 0) & (F.size(released) > 0) & F.col("_text").isNotNull() & F.col("_at").isNotNull()
    rows = rows.withColumn("_inside", inside).withColumn("_released", released).withColumn("_condition", enclosing_condition_udf(F.when(look, F.col("_text")), F.col("_at")))
    around = F.array_intersect(found(F.coalesce("_condition", F.lit("")), ERROR_POINTER), F.col("_released"))
    rows = rows.withColumn("suppressed", F.array_min(F.when(F.size("_inside") > 0, F.col("_inside")).otherwise(around)))
    at_label = anchor.rlike(LABEL) | F.rtrim(anchor).endswith(":") | fix.rlike(LABEL)
    withheld = F.col("suppressed").isNull() & at_label & (F.size("_released") > 0)
    lives = F.coalesce("where_it_lives", F.lit(""))
    rows = rows.withColumn("fix_withheld", F.when(withheld, fix)).withColumn("fix", F.when(withheld, F.lit(None).cast("string")).otherwise(F.col("fix")))
    rows = rows.withColumn("where_it_lives", F.when(F.col("suppressed").isNull() & F.lower(lives).contains("not provided") & F.col("_text").isNotNull(), F.trim("file")).otherwise(F.col("where_it_lives")))
    copies = near_duplicates(rows.where("suppressed is null").select(*key, seq, "exploitation"), key, seq, "exploitation").where("flagged").select(*key, seq, F.lit(True).alias("_copied"))
    flags = F.filter(F.array(F.when(F.col("fix_withheld").isNotNull(), "release at label"), F.when(F.col("_copied").isNotNull(), "copied narrative")), lambda x: x.isNotNull())
    return rows.join(copies, [*key, seq], "left").withColumn("flags", flags).select(*findings.columns, "suppressed", "fix_withheld", "flags")


@F.pandas_udf(T.StringType())
def enclosing_condition_udf(text: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or pd.isna(n) else enclosing_condition(t.splitlines(), int(n)) for t, n in zip(text, line, strict=True)], dtype=object)


def validation_report(gated: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Per review the counters of the gate: suppressed, flagged (copied narratives and withheld fixes, each counted), duplicate_narratives, and of its
    anchors (``key``, disposition) how many there are, how many were dismissed, and whether there are some and all became findings."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    copied = F.array_contains("flags", "copied narrative")
    found = gated.groupBy(*key).agg(one(F.col("suppressed").isNotNull()).alias("suppressed"), (one(copied) + one(F.col("fix_withheld").isNotNull())).alias("flagged"), one(copied).alias("duplicate_narratives"))
    seen = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("anchors"), one(F.col("disposition") == "dismissed").alias("dismissed"))
    names = ["suppressed", "flagged", "duplicate_narratives", "anchors", "dismissed"]
    out = found.join(seen, key, "full_outer").select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("all_anchors_became_findings", (F.col("anchors") > 0) & (F.col("dismissed") == 0))


def corroboration_floor(findings: DataFrame, floor: float = 0.8) -> DataFrame:
    """A finding that a rule matched and that scores high enough is vulnerable, whatever was said, and medium at least. Where that changes it,
    cross_check says so, and so does the end of its explanation."""
    matched = F.array_sort(F.coalesce("matched_patterns", F.array().cast("array<string>")))
    firm = (F.size(matched) > 0) & F.coalesce(F.col("score") >= floor, F.lit(False))
    low = severity_rank(F.coalesce("severity", F.lit(""))) < severity_rank(F.lit("medium"))
    changed = firm & (~F.coalesce("is_vulnerable", F.lit(False)) | low)
    note = F.when(changed, F.concat(F.lit("[cross-check] Score "), F.format_number("score", 2), F.lit(f" >= {floor:.2f} and rules matched ["), F.array_join(matched, ", "), F.lit("]; a downgrade was overridden.")))
    said = F.trim(F.concat_ws(" ", F.coalesce("explanation", F.lit("")), note)) if "explanation" in findings.columns else note
    return findings.withColumns(
        {"downgrade_blocked": changed, "cross_check": note, "explanation": said, "severity": F.when(firm & low, "medium").otherwise(F.col("severity")), "is_vulnerable": F.when(firm, True).otherwise(F.col("is_vulnerable"))}
    )
