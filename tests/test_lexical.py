import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.functions import lexical as L
from sievework.operators import rules as R


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1'\"\\/*\n(){};R \t"), max_size=60), st.booleans())
def test_mask_keeps_length_and_lines(text, keep):
    out = L.mask(text, keep)
    assert len(out) == len(text)
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(out) if c == "\n"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('a = "x;y"; // c', 'a = "   ";     '),
        ("'\\''; b", "'  '; b"),
        ("1'000'000 + 'x'", "1'000'000 + ' '"),
        ("/* a\n b */ c", "    \n      c"),
        ('R"q(a)" b)q" + 1', "             + 1"),
        ('"a\\"b" c', '"    " c'),
        ("// a \\\nb\nc", "      \n \nc"),
        ('"open\nnext', '"    \nnext'),
    ],
)
def test_mask(text, want):
    assert L.mask(text) == want


CODE = """#include <x.h>
struct S {
  int a;
  int get() const { return a; }
};
int table[] = { 1, 2 };

namespace n {
template <class T>
T pick(T a,
       T b)
{
  if (a) { return b; }
  auto f = [](int x) { return x; };
  return a;
}
}
static int old(a, b)
  int a;
  int b;
{
  return a + b;
}
C::C(int v) : v_(v), w_{v} { init(); }
bool operator==(const S& a, const S& b) { return a.a == b.a; }
void declared(int);
"""


def test_function_spans():
    lines = CODE.split("\n")
    spans = L.function_spans(CODE)
    heads = [lines[a].strip() for a, _ in spans]
    assert heads == ["int get() const { return a; }", "template <class T>", "static int old(a, b)", "C::C(int v) : v_(v), w_{v} { init(); }", "bool operator==(const S& a, const S& b) { return a.a == b.a; }"]
    assert all(lines[b - 1].rstrip().endswith("}") for _, b in spans)
    assert L.function_spans("") == [] and L.function_spans("}}}{{{") == []


def test_call_arguments():
    assert L.call_arguments("a, f(b, c), d[1, 2]") == ["a", "f(b, c)", "d[1, 2]"]
    assert L.call_arguments("a)") is None and L.call_arguments("(a") is None and L.call_arguments("") == []


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.integers(-9, 9) | st.text(st.sampled_from('ab"\\,]}'), max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("k,\"", max_size=3), x, max_size=4), max_leaves=12), st.integers(0, 200))
def test_repair_json(value, cut):
    text = json.dumps([value, value])
    out = L.repair_json(text[: max(1, cut % (len(text) + 1))])
    if out is not None:
        json.loads(out)
    assert L.repair_json(text) == text


def test_repair_json_keeps_complete_elements():
    assert json.loads(L.repair_json('{"findings": [{"a": 1}, {"a": 2}, {"a": ')) == {"findings": [{"a": 1}, {"a": 2}]}
    assert L.repair_json('{"a": 1, "findings": [{"t": "x') == '{"a": 1}'
    assert L.repair_json('[1, 2, "a,]') == "[1, 2]" and L.repair_json('{"a": "b\\\\", "c": [1], "d') == '{"a": "b\\\\", "c": [1]}'
    assert L.repair_json("no json") is None and L.repair_json("") is None and L.repair_json("{") is None


def test_repair_json_of_a_long_tail():
    """The last complete element may stand before any number of brackets and commas that cannot be closed."""
    text = '{"done": [1, 2], "open": {' + ", ".join(f'"k{i}": {{"v": [{i}]}}' for i in range(2000))
    assert json.loads(L.repair_json(text + ', "x": "' + "],{" * 400))["done"] == [1, 2]


def test_enclosing_condition():
    lines = ["void f() {", "  a();", "  b();", "  if (x > 0) {", "    g(); // {", "  }", "  c();", "}"]
    assert L.enclosing_condition(lines, 5) == "  a();   b();   if (x > 0) {"
    assert L.enclosing_condition(lines, 7) == L.enclosing_condition(lines, 6) == "void f() {"
    assert L.enclosing_condition(["int a;"], 1) == ""


HITS = {
    "gets": "gets(buf);",
    "system": "system(cmd);",
    "popen": "f = popen(c, m);",
    "strcpy": "strcpy(a, b);",
    "strcat": "strcat(a, b);",
    "sprintf": 'sprintf(a, "%d", b);',
    "scanf_percent_s": 'scanf("%s", a);',
    "memcpy": "memcpy(a, b, n);",
    "memmove": "memmove(a, b, n);",
    "alloca": "alloca(n);",
    "reinterpret_cast": "reinterpret_cast<int*>(p);",
    "const_cast": "const_cast<char*>(p);",
    "printf_format_string": "printf(msg);",
    "fprintf_format_string": "fprintf(stderr, msg);",
    "snprintf_format_string": "snprintf(a, n, fmt);",
    "hardcoded_credentials": 'char *password = "x1y";',
    "vsprintf_unbounded": "vsprintf(a, f, v);",
    "wcscpy_wcscat": "wcscpy(a, b);",
    "stpcpy_unbounded": "stpcpy(a, b);",
    "bcopy_legacy": "bcopy(a, b, n);",
    "getwd_unbounded": "getwd(a);",
    "realpath_fixed_buf": "realpath(p, out);",
    "scanf_family_unbounded": 'sscanf(s, "%[a-z]", a);',
    "malloc_strlen_no_nul": "p = malloc(strlen(s)); if (p) {}",
    "alloc_mul_overflow": "p = malloc(n * size); if (p) {}",
    "realloc_mul_overflow": "q = realloc(p, n * 4); if (q) {}",
    "new_array_mul_overflow": "new int[n * m];",
    "memcpy_mul_len_overflow": "memcpy(a, b, n * 4);",
    "alloc_size_underflow": "p = malloc(n - 1); if (p) {}",
    "alloc_size_from_atoi": "p = malloc(atoi(s)); if (p) {}",
    "exec_path_search": "execvp(a, b);",
    "dlopen_untrusted_lib": "dlopen(n, f);",
    "weak_crypto_primitive": "MD5(a, n, o);",
    "unix_crypt_weak_hash": "crypt(k, s);",
    "ecb_mode_cipher": "EVP_aes_128_ecb();",
    "insecure_prng": "rand();",
    "insecure_secret_comparison": "strcmp(user_hmac, given);",
    "world_writable_perms": "chmod(p, 0777);",
    "insecure_temp_file": "tmpnam(a);",
    "access_toctou": "access(p, R_OK);",
    "setuid_privilege_change": "setuid(0);",
    "new_delete_mismatch": "int *a = new int[4]; delete a;",
    "free_then_use": "free(p); p->x = 1;",
    "double_free": "free(p); free(p);",
    "use_after_move": "g(std::move(s)); s.size();",
    "dangling_cstr": "char *c = make(a).c_str(); use(c);",
    "string_view_temporary": 'std::string_view v = std::string("x");',
    "iterator_invalidation": "for (auto x : v) { v.push_back(x); }",
    "vprintf_format": "vprintf(fmt, args);",
    "strncpy_no_nul": "strncpy(a, b, n); use(a);",
    "malloc_no_null_check": "p = malloc(8); p[0] = 1;",
    "strtok_nonreentrant": "strtok(s, d);",
}
MISSES = {
    "gets": "fgets(buf, n, f); // gets(",
    "insecure_secret_comparison": 'strncmp(hdr, "password:", 9); memcmp(a, b, sizeof(digest));',
    "unix_crypt_weak_hash": "o->crypt(k, s);",
    "dangling_cstr": "return member.c_str();",
    "use_after_move": "g(std::move(s)); s = t; s.size();",
    "memcpy": "memcpy(a, b, sizeof(a));",
    "printf_format_string": 'printf("%s", msg);',
    "access_toctou": "o->access(p); ns::access(p);",
    "free_then_use": "free(p); p = NULL; p->x = 1;",
    "double_free": "free(p); p = 0; free(p);",
    "malloc_no_null_check": "p = malloc(8); if (!p) return;",
    "strncpy_no_nul": "strncpy(a, b, n); a[n - 1] = '\\0';",
    "new_delete_mismatch": "int *a = new int[4]; delete[] a;",
    "realpath_fixed_buf": "realpath(p, NULL);",
    "world_writable_perms": "chmod(p, 0644);",
    "iterator_invalidation": "for (auto x : v) { w.push_back(x); }",
}


def test_catalogue_is_complete():
    assert len(R.CODE_RULES) == 52 == len(HITS) and {r.id for r in R.CODE_RULES} == set(HITS)


@pytest.mark.parametrize("rule", HITS)
def test_rule_hits(rule):
    assert (rule, 2) in R.scan_code(f"void f() {{\n{HITS[rule]}\n}}")


@pytest.mark.parametrize("rule", MISSES)
def test_rule_misses(rule):
    assert rule not in [r for r, _ in R.scan_code(MISSES[rule])]


def test_suppression():
    assert R.scan_code("gets(a); // scan:ignore") == []
    assert R.scan_code("gets(a); // scan:ignore[strcpy]") == [("gets", 1)]
    assert R.scan_code("gets(a); // scan:ignore[strcpy, gets]") == []


def test_members_and_qualified_calls():
    assert [r for r, _ in R.scan_code("s->gets(a); ns::strcpy(a, b); std::system(c);")] == ["gets", "system", "strcpy"]


def test_long_arguments_are_read_whole():
    long = " + ".join(f"offset_{i}" for i in range(2000))
    assert [r for r, _ in R.scan_code(f"memcpy(a, b + {long}, sizeof(a));")] == []
    assert [r for r, _ in R.scan_code(f"fprintf(out[{long}], message);")] == ["fprintf_format_string"]
    assert "memcpy" in [r for r, _ in R.scan_code(f"memcpy(a, b + {long}, sizeof(c));")]


def test_findings_of_functions_and_of_what_is_between():
    code = "#define COPY(d, s) strcpy(d, s)\n\nint safe(int x) {\n    return x + 1;\n}\n\nvoid danger(char *s) {\n    char b[4];\n    strcpy(b, s);\n    gets(b);\n}\nvoid other(char *p) {\n    free(p);\n}\nvoid next(char *p) {\n    free(p); /* gets(p) */\n}\n"
    got = R.scanned_spans(code)
    assert got == [(1, 1, [("strcpy", 1)]), (7, 11, [("strcpy", 9), ("gets", 10)])]  # a free in one function says nothing of the next
    assert R.scanned_spans("") == [] and R.scanned_spans("gets(a);") == [(1, 1, [("gets", 1)])]
    assert R.primary({"strcpy", "gets", "memcpy"}).id == "gets" and R.primary({"memmove", "memcpy"}).id == "memcpy"


def test_long_sources_take_time_in_proportion():
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        R.scanned_spans("void f() {\n" + "  p = malloc(8);\n  free(p); q[3] = 1;\n" * (n // 2) + "}\n")
        R.scanned_spans("int a[][2] = {" + "{1, 2},\n" * n + "};\n")
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_no_pattern_runs_away():
    for text in ("(" * 4000, "a" * 8000, 'password' * 800, "malloc(" * 1500, "memcpy(a, " * 1200, "/*" * 3000, "memcpy(" + "a," * 2000 + "x)", "chmod(" + "a," * 2000 + "0777)"):
        began = time.perf_counter()
        R.scan_code(text)
        assert time.perf_counter() - began < 5


def test_every_rule_is_tried_where_it_can_match(monkeypatch):
    """Rules are picked by the words of a text: the same hits as when all are tried."""
    texts = ["\n".join(("void f() {", *some, "}", "", " " * 50)) for some in ([*HITS.values()], [*MISSES.values()], ["paſſword = 'x'; // gets(", 'paſſword = "abcd";', "xgets(a); gets_(b);", 'R"x(', "gets(a);"])]
    for code in [*texts, *HITS.values(), *MISSES.values(), *(x.upper() for x in HITS.values())]:
        monkeypatch.undo()
        got = R.scan_code(code), R.scanned_spans(code)
        monkeypatch.setattr(R, "_rules_in", lambda text: set(range(len(R.CODE_RULES))))
        assert got == (R.scan_code(code), R.scanned_spans(code))


def test_text_without_a_rules_words_costs_little():
    """Next to finding the functions, not 52 searches of every text."""
    code = "int f(int n)\n{\n  return n + 1;\n}\n" * 4000 + "/* " + "a comment of many words\n" * 60000 + " */"
    took = []
    for call in (L.function_spans, R.scanned_spans):
        began = time.process_time()
        got = call(code)
        took.append(time.process_time() - began)
    assert got == [] and took[1] < 4 * took[0] + 0.5


def test_long_blanks_take_time_in_proportion():
    code = "void f(char *a, char *b) {\n  strncpy(a, b, 4); /* " + "word " * 20000 + "*/\n  a[3] = 0;\n}\n"
    began = time.process_time()
    assert R.scanned_spans(code) == [] and R.scanned_spans(code.replace("a[3]", "c[3]")) == [(1, 4, [("strncpy_no_nul", 2)])]
    assert time.process_time() - began < 2
