import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import lmscore
from sievework.llm.queries import op3_lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, wanted):
    """(doc_id, tokens, target loss, background loss) of every row, from the words themselves; each row's own counts are left out."""
    texts = [(i, [w.lower() for w in WORD.findall(t or "")]) for i, t in rows]
    count = lambda some: (Counter(w for t in some for w in t), Counter(p for t in some for p in zip(t, t[1:])), sum(map(len, some)))
    models = count([t for i, t in texts if i in wanted]), count([t for _, t in texts])
    scales = 1.0, models[0][2] / max(1, models[1][2])
    vocabulary = len(models[1][0])
    out = []
    for i, text in texts:
        own = count([text])
        means = []
        for (one, two, total), scale, inside in zip(models, scales, (i in wanted, True)):
            left = lambda all_, mine, x: (all_[x] - inside * mine[x]) * scale  # noqa: B023, E731
            loss = 0.0
            for before, word in zip([None, *text], text):
                p = (left(one, own[0], word) + lmscore.ALPHA) / ((total - inside * len(text)) * scale + lmscore.ALPHA * vocabulary)
                if before is not None:
                    p = (left(two, own[1], (before, word)) + lmscore.MU * p) / (left(one, own[0], before) + lmscore.MU)
                loss -= math.log(p)
            means.append(loss / len(text) if text else None)
        out.append((i, len(text), *means))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(lmscore, "BROADCAST_IDS", broadcast)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{x}" if i % 2 else f"v{x}" for x in rng.zipf(1.5, 60) % 50)) for i in range(40)]
    rows += [(100, None), (101, " \n"), (102, "one"), (102, "one"), (None, "w1 w2"), (103, "w1 w2 " * 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(40)] + [(None, 1), (102, None), (1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in op3_lmscore(spark, str(tmp_path)).collect()), key=lambda r: (str(r[0]), r[1]))
    want = sorted(brute_force(rows, {i for i in range(40) if i % 2}), key=lambda r: (str(r[0]), r[1]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == (None, None) if b[2] is None else a[2:] == pytest.approx(b[2:], rel=1e-4)


def test_wanted_texts_score_lower(spark):
    path = "/root/testdata/sf0.01"
    scores = {r.doc_id: r.score for r in op3_lmscore(spark, path).collect() if r.score is not None}
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    good, bad = ([scores[r.doc_id] for r in labels if r.quality == q and r.doc_id in scores] for q in (1, 0))
    assert np.mean(good) < np.mean(bad)


def test_nothing_wanted_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = docs.select("doc_id").limit(0)
    assert lmscore.score(docs, none).first().score == 0
    assert lmscore.score(docs.limit(0), none).count() == 0


def test_counts_are_those_of_the_words_themselves(spark, monkeypatch):
    """60,000 distinct words and pairs, several chunks and ranges: none may share a count."""
    monkeypatch.setattr(lmscore, "CHUNK", 20_000, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join([f"x{x}" for x in rng.integers(0, 60_000, 600)] + ["the"] * 200)) for i in range(200)]
    rows += [(300, rows[7][1]), (301, rows[9][1])]
    wanted = set(range(0, 200, 3))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.score(docs, spark.createDataFrame([(i,) for i in wanted], "doc_id int")).collect()}
    assert len(got) == len(rows)
    for i, _, *losses in brute_force(rows, wanted):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(tuple(losses), rel=1e-9)


def test_texts_that_stand_twice_score_apart(spark):
    """Planted in a driver table: texts of invented words, each twice; their losses differ from all that stand once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(9)
    planted = [(10**9 + i, " ".join(f"q{x:x}z" for x in rng.integers(0, 1 << 40, 200))) for i in range(40)]
    planted += [(2 * 10**9 + i % 10**9, t) for i, t in planted]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    got = lmscore.score(docs.union(spark.createDataFrame(planted, "doc_id long, text string")), labels).collect()
    ours = [r.score for r in got if r.doc_id >= 10**9]
    rest = sorted(r.score for r in got if r.doc_id < 10**9 and r.score is not None)
    assert sum(x > rest[int(0.95 * len(rest))] for x in ours) >= 0.9 * len(ours)


def peak(run):
    """What ``run`` returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_range_is_added_up_in_pieces():
    """Sums of a large range are exact, and take little more room than its keys and counts."""
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 56, 400_000, dtype=np.uint64))
    rows, total = [], Counter()
    for k in range(12):
        keys = np.sort(rng.choice(pool, 200_000, replace=False))
        counts = rng.integers(1, 9, len(keys))
        rows.append((0, k, len(keys), lmscore.packed(np.diff(keys, prepend=np.uint64(0))), lmscore.packed(counts // 2), lmscore.packed(counts), 0, 0, keys, counts))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    batch = pa.RecordBatch.from_pylist([dict(zip(lmscore.QUESTION.names, r)) for r in rows], lmscore.QUESTION)
    ((out,), most) = peak(lambda: list(lmscore._answers(iter([batch]))))
    assert most < 47 * sum(r[2] for r in rows)
    assert sum(out.column("n_words").to_pylist()) == sum(k % 2 == 0 for k in total)
    for r, got in zip(rows, out.to_pylist()):
        assert got["chunk"] == r[1] and lmscore.unpacked(got["background"], got["n"]).tolist() == [total[k] for k in r[8].tolist()]


def test_a_chunk_is_hashed_a_few_texts_at_a_time():
    texts = pa.array([" ".join(["extraordinarily unquestionable"] * 600)] * 250)
    chunk, most = peak(lambda: lmscore.Chunk(texts))
    assert len(chunk.size) == 250 and set(chunk.size.tolist()) == {1200} and len(chunk.keys) == 4
    assert most < 15 * texts.nbytes


def test_python_gets_few_chunks_at_once(spark, monkeypatch):
    """All three stages limit what reaches Python at once, whatever a partition holds."""
    seen = []
    real = lmscore.stage
    monkeypatch.setattr(lmscore, "stage", lambda df, name, *a, **b: seen.append((name, df.schema, a)) or real(df, name, *a, **b))
    rows = [(i, " ".join(f"w{i * 7 % 90}x{k}" for k in range(30))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    assert lmscore.score(docs, docs.select("doc_id").limit(9)).count() == 90
    assert [name for name, _, _ in seen] == ["chunks", "answers", "scores"]
    assert all(a == (lmscore.BATCH_BYTES,) for _, _, a in seen)
