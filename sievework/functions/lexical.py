"""Lexical state machines over C-like text, as plain functions and as Arrow-batched UDFs. They need memory of what came
before in a text, which expressions do not have; everything else stays in expressions."""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: What begins neither a comment nor a literal.
PLAIN = re.compile(r"[^\"'/uULR]+")
RAW_STRING = re.compile(r'(?:u8|u|U|L)?R"([^ ()\\\t\v\f\n]{0,16})\(')


def mask(text: str, keep_strings: bool = False) -> str:
    """Comments and string and character literals blanked by spaces, quotes and line breaks kept, so that length and lines stay.

    A raw string ends only with its own delimiter; one that never ends, like an open comment, is blank to the end. A single
    quote between digits is a digit separator. Other literals end at their quote or, unless the line break is escaped, at
    the line's end.
    """
    return masks(text)[keep_strings]


def masks(text: str) -> tuple[str, str]:
    """``mask`` of a text without and with its literals, in one pass."""
    out: list[str] = []
    kept: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = i
            while (k := text.find("\n", j)) >= 0 and text[k - 1] == "\\":
                j = k + 1
            j = n if k < 0 else k
            code = whole = _blank(text[i:j])
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            code = whole = _blank(text[i:j])
        elif c in "uULR" and (m := RAW_STRING.match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            close = f'){m.group(1)}"'
            j = text.find(close, m.end())
            j = n if j < 0 else j + len(close)
            code, whole = _blank(text[i:j]), text[i:j]
        elif c == '"' or (c == "'" and not (i and text[i - 1].isalnum() and i + 1 < n and text[i + 1].isalnum() and _in_number(text, i))):
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + 1 if j < n and text[j] == c else j)
            whole = text[i:j]
            closed = len(whole) > 1 and whole.endswith(c)
            code = c + _blank(whole[1 : len(whole) - closed]) + c * closed
        else:
            j = plain.end() if (plain := PLAIN.match(text, i)) else i + 1
            code = whole = text[i:j]
        out.append(code)
        kept.append(whole)
        i = j
    return "".join(out), "".join(kept)


def _blank(text: str) -> str:
    return "\n".join([" " * len(line) for line in text.split("\n")])


def _in_number(text: str, i: int) -> bool:
    """Whether the quote at ``i`` stands inside a number: the word before it begins with a digit."""
    j = i
    while j and (text[j - 1].isalnum() or text[j - 1] in "_'."):
        j -= 1
    return text[j].isdigit()


CONTAINER = re.compile(r"\b(?:class|struct|union|namespace|enum)\b[^;{}()]*$|\bextern\s*(?:\"\s*\")?\s*$")
NOT_FUNCTIONS = frozenset(("if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else"))
CALLED = re.compile(r"([A-Za-z_~][\w:~]*|operator\s*[^\s\w(]{1,3}|operator\s*\(\s*\))\s*$")
LOOK_BACK = 40


def function_spans(text: str, masked: str | None = None) -> list[tuple[int, int]]:
    """(first line, line after the last), from 0, of function bodies with their signatures.

    Braces are matched on masked text. A brace opens a function if what stands before it back to the last `;`, `{`, `}` or
    preprocessor line is a signature: a name with a parameter list and nothing that assigns behind it. Braces of classes, namespaces and the like are
    looked into; those inside functions and initialisers are not.
    """
    code = re.sub(r"(?m)^[ \t]*#(?:.*\\\n)*.*$", lambda m: re.sub(r"[^\n]", " ", m.group()), (mask(text) if masked is None else masked).rstrip())
    breaks = [m.start() for m in re.finditer("\n", code)]
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    begin = functions = 0
    for m in re.finditer(r"[{};]", code):
        at, c = m.start(), m.group()
        if c == "{":
            if functions or stack and stack[-1][0] == "values":
                stack.append(("inner" if functions else "values", begin))
                begin = m.end() if functions else begin
                continue
            head = code[begin:at]
            kind = "function" if _is_signature(head) else "container" if CONTAINER.search(head) else "values" if head.rstrip().endswith(("=", ",", "(", "{")) else "other"
            stack.append((kind, begin + len(head) - len(head.lstrip())))
            functions += kind == "function"
            if kind in ("function", "container"):
                begin = m.end()
        elif c == "}":
            kind, start = stack.pop() if stack else ("", 0)
            if kind == "function":
                functions -= 1
                spans.append((bisect_left(breaks, start), bisect_left(breaks, at) + 1))
            if kind in ("other", "values"):
                continue  # what follows still belongs to the declaration
            begin = m.end()
        elif (functions or not _old_style(code[begin:at])) and not (stack and stack[-1][0] == "values"):
            begin = m.end()
    return sorted(spans)


def _old_style(head: str) -> bool:
    """Whether ``head`` may be a definition whose parameters are declared between `)` and `{`."""
    close = head.find(")")
    return close > 0 and head.count("\n") <= LOOK_BACK and bool(re.fullmatch(r"\s*\n\s*(?:const\s+|unsigned\s+|struct\s+)*[A-Za-z_]\w*[\s*]+\w[\w\s,*\[\]]*(?:;\s*[A-Za-z_][\w\s,*\[\];]*)?", head[close + 1 :]))


def _is_signature(head: str) -> bool:
    depth, close = 0, -1
    for i, c in enumerate(head):
        if c == "(":
            if depth == 0:
                name = CALLED.search(head[:i])
                if close < 0 and name and name.group(1) not in NOT_FUNCTIONS and "=" not in re.sub(r"operator\s*\S+", "", head[:i]):
                    close = 0
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0 and close == 0:
                close = i + 1
    if close <= 0 or depth:
        return False
    tail = head[close:]
    if re.match(r"\s*:(?!:)", tail) and re.search(r"[\w>]\s*$", tail):
        return False  # a member initialised in braces: the body is still to come
    return not re.match(r"\s*=", tail) and not re.search(r"[^=!<>]=[^=]", re.sub(r"\{[^{}]*\}", "", tail.split(":", 1)[0]))


def call_arguments(text: str) -> list[str] | None:
    """Arguments of a call, cut at the commas outside brackets; None where brackets do not match."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return None
        elif c == "," and not depth:
            out.append(text[begin:i].strip())
            begin = i + 1
    if depth:
        return None
    last = text[begin:].strip()
    return [*out, last] if out or last else []


def repair_json(text: str) -> str | None:
    """A document cut off in the middle, cut back to the end of its last complete element (a comma or a closing bracket outside strings)
    and closed there. A whole document is left alone; None where nothing can be saved."""
    text = text.strip()
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    open_: list[str] = []
    last = None
    for m in JSON_TOKEN.finditer(text):
        c = m.group()[0]
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                break
            last = m.end(), "".join(reversed(open_))
        elif c == ",":
            last = m.start(), "".join(reversed(open_))
    if last is None or not last[0]:
        return None
    out = text[: last[0]] + last[1]
    try:
        json.loads(out)
    except ValueError:
        return None
    return out


#: Strings, closed or not, and what stands between elements.
JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[\]{},]', re.S)


def similarity(a: str, b: str) -> float:
    """Share of matching blocks (Ratcliff and Obershelp)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def enclosing_condition(lines: list[str], line: int) -> str:
    """Where the innermost block around ``line`` (from 1, with its own braces) is opened: that line and the two before it, as
    one; '' outside all blocks. Braces in comments and literals don't count."""
    stack: list[int] = []
    for i, code in enumerate(mask("\n".join(lines)).split("\n")[:line], 1):
        for c in code:
            if c == "{":
                stack.append(i)
            elif c == "}" and stack:
                stack.pop()
    return " ".join(lines[max(0, stack[-1] - 3) : stack[-1]]) if stack else ""


@F.pandas_udf(T.StringType())
def mask_udf(text: pd.Series) -> pd.Series:
    return text.map(mask, na_action="ignore")


@F.pandas_udf(SPANS)
def function_spans_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in function_spans(t)] if t is not None else [])


@F.pandas_udf(T.StringType())
def repair_json_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else repair_json(t))


def similarity_udf(threshold: float):
    """Whether two texts are similar to at least the threshold; upper bounds of the share are tried first."""

    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            m = difflib.SequenceMatcher(None, x, y)
            out.append(m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold)
        return pd.Series(out, dtype=bool)

    return near
