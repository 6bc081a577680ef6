"""Scalar normalisers as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it, spelt out so that Spark and other engines agree.
ANY_SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: What labels, severities and levels are called.
TRUE_WORDS = ("1", "true", "yes", "vul", "vulnerable")
FALSE_WORDS = ("0", "false", "no", "nonvul", "clean", "safe")
SEVERITY_SYNONYMS = {"moderate": "medium", "important": "high", "severe": "high", "warning": "medium", "informational": "info", "note": "info", "blocker": "critical", "none": "info"}
ERROR_LEVEL = ("critical", "high", "error")
NOTE_LEVEL = ("low", "info", "style", "performance", "portability", "information", "informational", "note")
SEVERITY_CONFIDENCE = {"info": 0.25, "low": 0.4, "medium": 0.6, "high": 0.8, "critical": 0.95}
#: Words that don't tell one finding from another, in titles and in anchors, and words of C types.
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "to", "and", "or", "is", "for", "with", "without", "via", "by", "unchecked", "missing", "possible", "potential", "buffer", "issue", "field", "value", "data", "code")
GENERIC_ANCHORS = (
    "dhcp", "packet", "message", "size", "len", "length", "code", "buf", "buffer", "offset", "option", "options", "field", "value", "data", "type", "flag", "flags", "const", "void",
    "struct", "char", "enum", "define", "sizeof", "uint8", "uint16", "uint32", "int32", "be32", "be16", "bool", "null",
)
TYPE_WORDS = ("uint8_t", "uint16_t", "uint32_t", "uint64_t", "be32_t", "be16_t", "int", "int32_t", "int16_t", "struct", "define", "char", "void", "size_t", "const", "union", "enum", "unsigned", "bool")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ANY_SPACE, " "))


def drop_blank_lines(text: Column) -> Column:
    """Lines trimmed on the right, blank ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, ANY_SPACE + "$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def text_digest(text: Column) -> Column:
    return F.sha2(collapse_space(text).cast("binary"), 256)


def hash_bucket(*parts: Column, buckets: int = 100) -> Column:
    """int(sha1(parts joined by ::)[:8], 16) % buckets; null parts count as 'None'."""
    joined = F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.conv(F.substring(F.sha1(joined.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def stand_in_score(text: Column) -> Column:
    """The deterministic scorer used where no trained classifier is plugged in."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long") % 1000 / F.lit(1000.0)


def severity_rank(severity: Column, default: int = 0) -> Column:
    table = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(severity))), F.lit(default))


def normalize_severity(severity: Column, default: str | None = "medium") -> Column:
    """Synonyms to the five names; what is unknown, or null, becomes ``default``."""
    s = F.lower(F.trim(severity))
    names = F.create_map(*[F.lit(x) for pair in (*SEVERITY_SYNONYMS.items(), *zip(SEVERITIES, SEVERITIES, strict=True)) for x in pair])
    return F.coalesce(F.try_element_at(names, s), F.lit(default))


def known_severity(severity: Column) -> Column:
    """One of the five names, in lower case, or null; no synonyms."""
    s = F.lower(F.trim(severity))
    return F.when(s.isin(*SEVERITIES), s)


def sarif_level(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin(*ERROR_LEVEL), "error").when(s.isin(*NOTE_LEVEL), "note").otherwise("warning")


def normalize_label(value: Column) -> Column:
    """null stays null; known words become 0 and 1, integers stay what they are, anything else is 0."""
    s = F.lower(F.trim(value.cast("string")))
    number = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))
    return F.when(value.isNull(), None).when(s.isin(*TRUE_WORDS), 1).when(s.isin(*FALSE_WORDS), 0).otherwise(F.coalesce(number, F.lit(0)))


def normalize_language(value: Column, default: str = "c") -> Column:
    s = F.coalesce(F.lower(F.trim(value)), F.lit(""))
    return F.when(s == "", default).when(s.isin("c++", "cpp", "cxx"), "cpp").otherwise(s)


def language_of_path(path: Column, default: str = "c", headers: str = "cpp") -> Column:
    """By the ending, case aside. Headers are taken for C++, which also reads C."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
    return F.when(ext.isin(*CPP), "cpp").when(ext == ".h", headers).when(ext == ".c", "c").otherwise(default)


#: Endings of C++ files, and those that no other language has.
CPP = (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++", ".tcc", ".ipp", ".inl")
ONLY_CPP = (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")


def only_language(path: Column, endings: tuple[str, ...] = ONLY_CPP) -> Column:
    """Whether a file's name has one of the endings; null, blank and the word `None` have none."""
    ext = F.lower(F.regexp_extract(missing_word(F.trim(path)), r"[^/.][^/]*(\.[^./]*)$", 1))
    return F.coalesce(ext.isin(*endings), F.lit(False))


def missing_word(value: Column, word: str = "None") -> Column:
    """null for the word that stands for a missing value."""
    return F.when(value != word, value)


def first_cwe(text: Column) -> Column:
    """'CWE-n' of the first mention in any text, or null."""
    n = F.regexp_extract(text, r"(?i)CWE[-_ ]?([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def canonical_cwe(value: Column) -> Column:
    """A value that is a CWE number with or without prefix; zeros are stripped, 0 and more than five digits are rejected."""
    n = F.regexp_extract(F.trim(value.cast("string")), r"^(?i:cwe)?[-_: ]*0*([0-9]{1,5})$", 1)
    return F.when((n != "") & (n != "0"), F.concat(F.lit("CWE-"), n))


def line_numbers(text: Column) -> Column:
    """All integers named in a line reference such as '12-15, 14': at least 1, distinct, sorted."""
    found = F.regexp_extract_all(text, F.lit("([0-9]{1,9})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.greatest(F.lit(1), n.cast("int")))))


def region(start: Column, end: Column, matches: Column) -> Column:
    """struct(start_line, end_line), 1 <= start <= end: the span of the matched lines, clamped into the finding's own span if that is
    known, else the finding's span. A null start is unknown, 0 is a line out of range."""
    low = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    high = F.greatest(low, F.coalesce(end, low))
    inside = F.transform(F.filter(F.coalesce(matches, F.array().cast("array<int>")), lambda n: n.isNotNull()), lambda n: F.greatest(F.lit(1), n))
    clamp = lambda n: F.when(start.isNull(), n).otherwise(F.least(high, F.greatest(low, n)))
    some = F.size(inside) > 0
    first = F.when(some, clamp(F.array_min(inside))).otherwise(low)
    last = F.when(some, clamp(F.array_max(inside))).otherwise(high)
    return F.struct(first.cast("int").alias("start_line"), F.greatest(first, last).cast("int").alias("end_line"))


def confidence(score: Column, has_rule: Column) -> Column:
    """Score bucket (.8 high, .6 medium, .5 low, below very low), a notch up when a rule matched; null is unknown."""
    rank = F.when(score >= 0.8, 3).when(score >= 0.6, 2).when(score >= 0.5, 1).otherwise(0)
    rank = F.least(F.lit(3), rank + F.when(has_rule, 1).otherwise(0))
    return F.when(score.isNull(), "unknown").otherwise(F.element_at(F.array(*map(F.lit, ("very low", "low", "medium", "high"))), rank + 1))


def graded_confidence(severity: Column, flags: Column, fix_withheld: Column) -> Column:
    """From the severity's base, 0.2 less a flag and 0.1 less for a withheld fix, at least 0.05, to two places."""
    base = F.element_at(F.array(*[F.lit(SEVERITY_CONFIDENCE[x]) for x in SEVERITIES]), severity_rank(normalize_severity(severity)) + 1)
    return F.round(F.greatest(F.lit(0.05), base - flags * F.lit(0.2) - F.when(fix_withheld, 0.1).otherwise(0.0)), 2)


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 3, pattern: str = "[a-z0-9_]+") -> Column:
    """Distinct words of letters, digits and _ that are long enough and no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))
    return F.array_except(F.filter(found, lambda t: F.length(t) >= least), F.array(*map(F.lit, stop)))


def anchor_identifiers(text: Column) -> Column:
    """Distinct identifiers that tell one place in code from another."""
    return tokens(text, GENERIC_ANCHORS, 4, "[a-z_][a-z0-9_]{3,}")


def identifier(anchor: Column) -> Column:
    """The longest identifier of an anchor that is no word of a type, the first of equals, in lower case and at most 40 characters;
    without one, the anchor's words."""
    anchor = F.coalesce(anchor, F.lit(""))
    found = F.regexp_extract_all(anchor, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    found = F.filter(found, lambda t: ~F.lower(t).isin(*TYPE_WORDS))
    longest = F.reduce(found, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    return F.substring(F.when(longest != "", F.lower(longest)).otherwise(words_only(anchor)), 1, 40)


def words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def anchor_key(cwe: Column, anchor: Column, title: Column) -> Column:
    """struct(cwe, ident): one site in code, however it is described; the title stands in for an anchor that says nothing."""
    ident = F.coalesce(F.nullif(identifier(anchor), F.lit("")), F.substring(words_only(F.coalesce(title, F.lit(""))), 1, 24))
    return F.struct(F.lower(F.coalesce(cwe, F.lit(""))).alias("cwe"), ident.alias("ident"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def normal_path(path: Column) -> Column:
    """With / only, and without . steps and doubled or trailing /."""
    path = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"^(?:\./)+", ""), "(?<=.)/$", "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def strip_fences(text: Column) -> Column:
    """The text inside a Markdown code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z0-9_+-]*\n(.*?)\n?```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def serialized_bytes(*columns: str) -> Column:
    """Bytes of the row as one JSON line with a space behind each comma and colon between its fields, nulls written out."""
    compact = F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return (compact + 2 * len(columns) - 1 + 1).cast("long")


def numbered_lines(text: Column) -> Column:
    """Every line of a text behind its number."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.format_string("%4d| %s", i + 1, line)), "\n")


def reply_state(reply: Column) -> Column:
    """What a chat reply, a JSON document, has under message.content: `ok` for a string that is JSON, `unreadable` for one that is not, else what is wrong:
    `no object`, `no message`, `no content`; null for null."""
    v = F.try_parse_json(reply)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    message, content = F.try_variant_get(v, "$.message", "variant"), F.try_variant_get(v, "$.message.content", "variant")
    readable = F.try_parse_json(F.try_variant_get(v, "$.message.content", "string")).isNotNull()
    state = F.when(~kind(v).startswith("OBJECT"), "no object").when(~kind(message).startswith("OBJECT"), "no message").when(kind(content) != "STRING", "no content")
    return F.when(reply.isNotNull(), state.when(readable, "ok").otherwise("unreadable"))


def footprint_gb(weights_gb: Column, kv_gb_per_k: Column, context_k: Column) -> Column:
    return weights_gb + kv_gb_per_k * context_k
