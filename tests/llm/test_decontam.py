import random
import re

import pytest

from sievework.llm import decontam
from sievework.llm.queries import op9_decontam

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(docs, items, t=0.75):
    sets = [(i, s) for i, s in ((i, shingle_set(x)) for i, x in items) if s]
    out = []
    for d, text in docs:
        own = shingle_set(text)
        out += [(d, i, len(s & own), len(s)) for i, s in sets if len(s & own) >= t * len(s)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 16, 40, 59, 200, 900])))) for i in range(40)]
    items += [(90, None), (91, ""), (3, items[3][1])]
    docs = []
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.choice([0, 3, 50, 3000]))]
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items)[1] or "").split()
            part = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.05]) else w for w in part]
            cut = rng.choice([0, 0, len(part) // 6, len(part) // 3])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[cut:]
        docs.append((d, " ".join(text).upper() if d % 7 == 0 else "\n".join(text)))
    docs += [(500, None), (501, " "), (502, items[0][1]), (502, items[0][1]), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("group", [500_000, 900])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(decontam, "GROUP_WORDS", group)
    docs, items = corpus(group)
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in op9_decontam(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_force(docs, items)


def test_short_items_miss_nothing(spark):
    """Items of one to seven shingles, each in many texts among other words: every hit is a candidate."""
    rng = random.Random(8)
    items = [(i, " ".join(f"s{rng.randrange(10**6)}" for _ in range(4 + i % 8))) for i in range(300)]
    docs = [(d, " ".join([f"t{rng.randrange(10**6)}" for _ in range(30)] + items[d % 300][1].split() + [f"u{rng.randrange(10**6)}" for _ in range(30)])) for d in range(3000)]
    got = decontam.find_contained(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    wanted = {(d, d % 300) for d in range(3000) if len(items[d % 300][1].split()) > 4}
    assert {(r.doc_id, r.item_id) for r in got} == wanted


@pytest.mark.parametrize("group", [4_000_000, 900])
def test_rows_without_items(spark, monkeypatch, group):
    monkeypatch.setattr(decontam, "GROUP_WORDS", group)
    docs, items = corpus(7)
    docs += [(None, items[6][1] + " and more"), (None, "clean words only in here"), (77, items[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id")
    got = decontam.without_contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    clean = [(d, t) for d, t in docs if not brute_force([(0, t)], items)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, clean)) and got[0].__fields__ == ["doc_id", "text", "item_id"]


def test_driver_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in op9_decontam(spark, path).collect()), key=str)
    assert got == brute_force(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id int, text string")
    items = spark.createDataFrame([], "item_id int, text string")
    assert decontam.find_contained(docs, items).count() == 0
    assert decontam.find_contained(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
