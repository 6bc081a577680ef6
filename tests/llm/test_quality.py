import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sievework.llm import quality
from sievework.llm.queries import ORACLES, op8_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "depleted", "kept"]


def brute_force(rows):
    holders, docs = defaultdict(set), defaultdict(set)
    key = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    for i, text, host in rows:
        i = "" if i is None else i
        docs[host or ""].add(i)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host or "", key(line)].add(i)
    out = []
    for i, text, host in rows:
        text, host = text or "", host or ""
        w = WORD.findall(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = [x for x in lines if len(h := holders[host, key(x)]) >= 20 and len(h) >= min(quality.LINE_SHARE * len(docs[host]), quality.MANY_DOCS)]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        depleted = len(w) - lost < 0.5 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed, len(gone), lost, depleted, not failed and not depleted))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["#a", "é&", "x|<>", "7"]
    stock = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30]))) for _ in range(5)]
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(4)):
            lines.append(rng.choice([rng.choice(stock), rng.choice(stock).upper() + "  ", f"page {rng.randrange(99)} of 99"]))
        if rng.random() < 0.3 and lines:
            lines += [lines[0]] * 3
        rng.shuffle(lines)
        rows.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(900, None, "a"), (901, "", None), (902, " \t\n ", "a"), (903, "q", "a"), (903, "q", "a"), (904, "a b c " * 20_000, "a"), (None, stock[0], "b"), (None, "z y\n" + stock[0], "b")]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as host", "1 as n_words").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op8_quality(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_force(rows)


def test_what_a_large_host_asks_for_stops_growing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "LINE_SHARE", 0.9)
    monkeypatch.setattr(quality, "MANY_DOCS", 25)
    test_query_against_brute_force(spark, tmp_path)


def test_shuffled_join_gives_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    test_query_against_brute_force(spark, tmp_path)


def test_sql_with_null_ids(spark, tmp_path):
    rows = corpus() + [(None, "common line\nx", "b")] + [(2000 + i, "common line\ny", "b") for i in range(19)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(ORACLES["op8_quality"])
    want = sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in COLUMNS) for r in want.fetchall()), key=str)
    assert want == sorted((tuple(r[c] for c in COLUMNS) for r in op8_quality(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = duckdb.sql(ORACLES["op8_quality"])
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    want = sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)
    assert want == sorted((tuple(r[c] for c in COLUMNS) for r in op8_quality(spark, path).collect()), key=str)


def test_empty_table(spark):
    assert quality.rate(spark.createDataFrame([], "doc_id int, text string, source string")).count() == 0
