import hashlib
import random
import re

import pytest

from sievework.llm import substring
from sievework.llm.queries import op7_substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window=20):
    """doc_id -> (n_words, n_removed, kept words)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as parts", "2 as start").repartition(3).write.parquet(f"{path}/documents.parquet")
    want = brute_force([r for r in rows if r[0] is not None])
    got = op7_substring(spark, str(path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            n, removed, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest()), r.doc_id


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "ö!"]
    pool = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 25, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice(words) for _ in range(rng.randrange(30))]
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            text += part[a:] if rng.random() < 0.3 else part
        rows.append((rng.randrange(10**12) if i % 2 else i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "x"), (9005, "a b c d e " * 400), (9006, "a b c d e " * 30), (None, "a b c d e " * 30), (9007, " ".join(pool[-1]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    check(spark, tmp_path, corpus(seed))


def test_small_shards_and_salts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 30)
    monkeypatch.setattr(substring, "READERS", 3)
    check(spark, tmp_path, corpus(3))


@pytest.mark.parametrize("passage", [21, 30])
def test_passage_twice_in_a_later_text(spark, tmp_path, passage):
    part = lambda name, n=40: [f"{name}{i}" for i in range(n)]
    rows = [(1, " ".join(part("u") + part("p", passage) + part("v")))]
    for i in range(2, 12):
        rows.append((i, " ".join((part(f"x{i}_") + part("p", passage) + part(f"y{i}_")) * (2 + i % 2))))
    check(spark, tmp_path, rows)


def test_driver_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = brute_force(docs)
    for r in op7_substring(spark, path).collect():
        assert (r.n_words, r.n_removed) == want[r.doc_id][:2]


def test_text_keeps_its_white_space(spark):
    twice = " ".join(f"q{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a\n{twice}  b"), (2, f"c\t\n{twice}\n d  e")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    assert got == {1: f"a\n{twice}  b", 2: "c\t\nd  e"}


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(3)]
        own = "".join(rng.choice("abc") for _ in range(15))
        automaton = substring.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        want = [max(k for k in range(i + 2) if any(own[i + 1 - k : i + 1] in t for t in texts)) for i in range(len(own))]
        assert list(automaton.statistics(own)) == want


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_equal_ids_of_unequal_texts(spark):
    part = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, part("p")), (5, part("x", 300) + " " + part("p")), (9, part("q", 7) + " " + part("p") + " " + part("x", 30)), (9, part("p"))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 40, 0), (5, 340, 0), (9, 40, 40), (9, 77, 70)]


def test_inner_repeats_compare_words(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from sievework.llm.textkernel import word_chunks

    rng = random.Random(7)
    monkeypatch.setattr(substring, "mix", lambda x, seed=0: x & np.uint64(3))  # almost all windows share a hash
    for _ in range(20):
        own = [rng.choice("abc") for _ in range(rng.choice([25, 60]))] * rng.choice([1, 2])
        _, _, words = next(word_chunks(pa.array([" ".join(own)]), lower=False))
        seen = set()
        want = [i for i in range(len(own) - 19) if tuple(own[i : i + 20]) in seen or seen.add(tuple(own[i : i + 20]))]
        assert substring.inner_repeats(words, 0, len(own)).tolist() == want
