"""The catalogue of C and C++ rules over sources that are put together from the documents: what must be found follows from how they are built."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import rules as R
from sievework.plans.registry import query, table

#: Statements of one line and the rules that must hit them in a function of their own.
STATEMENTS = [
    ("gets(buf);", "gets"),
    ("o->gets(buf); o.strcpy(a, b); ns::strcat(a, b);", "gets strcpy strcat"),
    ("system(cmd);", "system"),
    ("f = popen(c, m);", "popen"),
    ('sprintf(a, "%d", b);', "sprintf"),
    ('scanf("%s", a);', "scanf_percent_s scanf_family_unbounded"),
    ("memcpy(a, b, n);", "memcpy"),
    ("memcpy(a, b, sizeof(a)); memmove(c, d, sizeof c);", ""),
    ("memmove(a, b, n);", "memmove"),
    ("alloca(n);", "alloca"),
    ("reinterpret_cast<int*>(p);", "reinterpret_cast"),
    ("const_cast<char*>(p);", "const_cast"),
    ("printf(msg);", "printf_format_string"),
    ('printf("%s", msg); // printf(msg);', ""),
    ("fprintf(stderr, msg);", "fprintf_format_string"),
    ("snprintf(a, n, fmt);", "snprintf_format_string"),
    ('char *password = "x1y2";', "hardcoded_credentials"),
    ("vsprintf(a, f, v);", "vsprintf_unbounded"),
    ("wcscpy(a, b);", "wcscpy_wcscat"),
    ("stpcpy(a, b);", "stpcpy_unbounded"),
    ("bcopy(a, b, n);", "bcopy_legacy"),
    ("getwd(a);", "getwd_unbounded"),
    ("realpath(p, out);", "realpath_fixed_buf"),
    ("realpath(p, NULL);", ""),
    ('sscanf(s, "%[a-z]", a);', "scanf_family_unbounded"),
    ("p = malloc(strlen(s)); if (p) {}", "malloc_strlen_no_nul"),
    ("p = malloc(n * size); if (p) {}", "alloc_mul_overflow"),
    ("q = realloc(p, n * 4); if (q) {}", "realloc_mul_overflow"),
    ("new int[n * m];", "new_array_mul_overflow"),
    ("memcpy(a, b, n * 4);", "memcpy memcpy_mul_len_overflow"),
    ("p = malloc(n - 1); if (p) {}", "alloc_size_underflow"),
    ("p = malloc(atoi(s)); if (p) {}", "alloc_size_from_atoi"),
    ("execvp(a, b);", "exec_path_search"),
    ("dlopen(n, f);", "dlopen_untrusted_lib"),
    ("MD5(a, n, o);", "weak_crypto_primitive"),
    ("crypt(k, s); o.crypt(k);", "unix_crypt_weak_hash"),
    ("EVP_aes_128_ecb();", "ecb_mode_cipher"),
    ("rand();", "insecure_prng"),
    ("strcmp(user_hmac, given);", "insecure_secret_comparison"),
    ("chmod(p, 0777);", "world_writable_perms"),
    ("chmod(p, 0644);", ""),
    ("tmpnam(a);", "insecure_temp_file"),
    ("access(p, R_OK);", "access_toctou"),
    ("o->access(p); ns::access(p);", ""),
    ("setuid(0);", "setuid_privilege_change"),
    ("int *a = new int[4]; delete a;", "new_delete_mismatch"),
    ("int *a = new int(4); delete[] a;", "new_delete_mismatch"),
    ("int *a = new int[4]; delete[] a;", ""),
    ("free(p); p->x = 1;", "free_then_use"),
    ("free(p); p = q; p->x = 1;", ""),
    ("free(p); free(p);", "double_free"),
    ("free(p); p = q; free(p);", ""),
    ("g(std::move(s)); s.size();", "use_after_move"),
    ("g(std::move(s)); s.clear();", ""),
    ("char *c = make(a).c_str(); use(c);", "dangling_cstr"),
    ("std::string t; return t.c_str();", "dangling_cstr"),
    ('std::string_view v = std::string("x");', "string_view_temporary"),
    ("for (auto x : v) { v.push_back(x); }", "iterator_invalidation"),
    ("for (auto x : v) { w.push_back(x); }", ""),
    ("vprintf(fmt, args);", "vprintf_format"),
    ("strncpy(a, b, n); use(a);", "strncpy_no_nul"),
    ("strncpy(a, b, n); a[n - 1] = '\\0';", ""),
    ("p = malloc(8); p[0] = 1;", "malloc_no_null_check"),
    ("p = malloc(8); if (!p) return; p[0] = 1;", ""),
    ("strtok(s, d);", "strtok_nonreentrant"),
    ("strcpy(a, b); // scan:ignore", ""),
    ("strcat(a, b); // scan:ignore[gets, strcat]", ""),
    ("gets(a); strcat(a, b); // scan:ignore[strcat]", "gets"),
]
FUNCTIONS = 5
_N = len(STATEMENTS)


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("*/"), F.lit("* /")), F.lit("scan:"), F.lit("scan ")).alias("text"))


def sources(spark, sf_dir):
    """(path, text): two lines, FUNCTIONS functions of four lines with a statement each, a blank line, a macro with one more, and the whole document as a
    comment. Every document has its own choice of statements."""
    chosen = lambda k: F.element_at(F.array(*[F.lit(s) for s, _ in STATEMENTS]), ((F.col("doc_id") * 5 + k * 13) % _N + 1).cast("int"))
    parts = [F.lit("#include <stdio.h>\nstatic int limit;")]
    for k in range(FUNCTIONS):
        parts += [F.lit(f"int f{k}(char *s, int n)\n{{"), F.concat(F.lit("  "), chosen(k)), F.lit("}")]
    parts += [F.lit(""), F.concat(F.lit("#define USE "), chosen(FUNCTIONS)), F.concat(F.lit("/* "), F.col("text"), F.lit(" */"))]
    return _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.array_join(F.array(*parts), "\n").alias("text"))


_CHOICE = ", ".join(f"({i}, '{rule}')" for i, (_, rules) in enumerate(STATEMENTS) for rule in rules.split())
_META = ", ".join(f"({i}, '{r.id}', '{r.cwe}', '{r.severity}')" for i, r in enumerate(R.CODE_RULES))
_HITS = f"""WITH choice(i, rule) AS (VALUES {_CHOICE}), meta(ord, rule, cwe, severity) AS (VALUES {_META}),
spans AS (SELECT doc_id, k, (doc_id * 5 + k * 13) % {_N} AS i, CASE WHEN k < {FUNCTIONS} THEN 3 + 4 * k ELSE {4 + 4 * FUNCTIONS} END AS a, CASE WHEN k < {FUNCTIONS} THEN 6 + 4 * k ELSE {4 + 4 * FUNCTIONS} + len(string_split(text, chr(10))) END AS b,
  CASE WHEN k < {FUNCTIONS} THEN 5 + 4 * k ELSE {4 + 4 * FUNCTIONS} END AS line FROM documents, range({FUNCTIONS + 1}) t(k)),
hits AS (SELECT doc_id::VARCHAR AS path, a, b, rule, cwe, severity, ord, line FROM spans JOIN choice USING (i) JOIN meta USING (rule))"""
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END * 100 - ord"


@query(_HITS + " SELECT path, a::INTEGER AS start_line, b::INTEGER AS end_line, rule, cwe, severity, line::INTEGER AS line FROM hits")
def code_scan(spark, sf_dir):
    """Hits of all rules, by function and by what stands between functions."""
    return R.scan_files(sources(spark, sf_dir))


@query(
    _HITS
    + f""", found AS (SELECT path, a, b, string_agg(DISTINCT rule, ',' ORDER BY rule) AS matched_patterns, arg_max(cwe, {_RANK}) AS cwe, arg_max(severity, {_RANK}) AS severity, string_agg(DISTINCT line::VARCHAR, ',') AS match_lines FROM hits GROUP BY path, a, b)
SELECT path AS file, a::INTEGER AS start_line, b::INTEGER AS end_line, matched_patterns, cwe, severity, match_lines, 1.0::DOUBLE AS score FROM found WHERE severity <> 'low'"""
)
def code_findings(spark, sf_dir):
    """One finding for each function and stretch, from medium up."""
    out = R.scan_findings(sources(spark, sf_dir), floor="medium", snippet=False)
    return out.select("file", "start_line", "end_line", F.array_join("matched_patterns", ",").alias("matched_patterns"), "cwe", "severity", F.array_join(F.col("match_lines").cast("array<string>"), ",").alias("match_lines"), "score")


@query(f'SELECT doc_id::VARCHAR AS path, CAST(2 + 4 * k AS INTEGER) AS start, CAST(6 + 4 * k AS INTEGER) AS "end" FROM documents, range({FUNCTIONS}) t(k)')
def function_spans(spark, sf_dir):
    from sievework.functions.lexical import function_spans_udf

    return sources(spark, sf_dir).select("path", F.explode(function_spans_udf("text")).alias("s")).select("path", "s.start", "s.end")


_PLAIN = "replace(replace(replace(text, '*/', '* /'), 'scan:', 'scan '), chr(92), '/')"


@query(
    f"""WITH t AS (SELECT doc_id, {_PLAIN} AS text FROM documents), p AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS line, regexp_replace(string_split(text, ' ')[1], '["\\n]', '.', 'g') AS word FROM t)
SELECT doc_id, sha256('int a; ' || regexp_replace('// ' || line, '[^\\n]', ' ', 'g') || chr(10) || 'char *w = "' || regexp_replace(word, '[^\\n]', ' ', 'g') || '";' || chr(10) || regexp_replace('/* ' || text || ' */', '[^\\n]', ' ', 'g') || ' int b;') AS digest FROM p"""
)
def mask_text(spark, sf_dir):
    """Comments and literals blanked, over sources with each whole document in a comment."""
    from sievework.functions.lexical import mask_udf

    text = F.replace(F.col("text"), F.lit("\\"), F.lit("/"))
    rows = _texts(spark, sf_dir).select("doc_id", text.alias("text"))
    word = F.regexp_replace(F.split("text", " ")[0], '["\n]', ".")
    source = F.concat(F.lit("int a; // "), F.split("text", "\n")[0], F.lit('\nchar *w = "'), word, F.lit('";\n/* '), F.col("text"), F.lit(" */ int b;"))
    return rows.select("doc_id", F.sha2(mask_udf(source).cast("binary"), 256).alias("digest"))


_WEAK = ", ".join(f"('{cwe}', '{a}', '{b}')" for cwe, (a, b, _) in ((c, tuple(x.replace("'", "''") for x in t)) for c, t in R.WEAKNESSES.items()))


@query(
    _HITS
    + f""", weak(cwe, issue, risk) AS (VALUES {_WEAK}), found AS (SELECT path, a, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS rules, arg_max(cwe, {_RANK}) AS cwe FROM hits GROUP BY path, a)
SELECT path AS file, a::INTEGER AS start_line, issue, 'Matches ' || rules || '.' AS what_code_does, risk AS what_could_go_wrong, 'high' AS confidence FROM found JOIN weak USING (cwe)"""
)
def explained_findings(spark, sf_dir):
    """What is said of each finding."""
    return R.explained(R.scan_findings(sources(spark, sf_dir), snippet=False)).select("file", "start_line", "issue", "what_code_does", "what_could_go_wrong", "confidence")
