"""Order-dependent operators against plain Python, and sources and sinks on files."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import dataset as D
from sievework.operators import findings as P
from sievework.operators import intervals as I
from sievework.operators import metrics as M
from sievework.operators import review as V
from sievework.sources import files, sinks


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_spans(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), a := rng.randrange(60), a + rng.randrange(6), rng.random()) for _ in range(60)]
    want = []
    for f in range(4):
        own: list[list] = []
        for _, a, b, s in sorted(r for r in rows if r[0] == f):
            if own and a <= own[-1][1] + 1:
                own[-1] = [own[-1][0], max(own[-1][1], b), max(own[-1][2], s), own[-1][3] + 1]
            else:
                own.append([a, b, s, 1])
        want += [(f, *o) for o in own]
    for bucket in (4096, 7):
        got = I.merge_spans(spark.createDataFrame(rows, "file int, a int, b int, score double"), ["file"], "a", "b", "score", bucket=bucket)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_snippets(spark):
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 7)], "file string, line_no int, line string")
    spans = spark.createDataFrame([("f", 2, 3), ("f", 5, 9), ("g", 1, 1)], "file string, a int, b int")
    assert {(r.file, r.a): r.snippet for r in I.with_snippets(spans, lines, ["file"], "a", "b").collect()} == {("f", 2): "l2\nl3", ("f", 5): "l5\nl6", ("g", 1): None}


def test_corroborate(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice("fg"), s := rng.randrange(200), s + rng.randrange(90)) for i in range(120)]
    want = {}
    for i, t, f, a, b in rows:
        want[i] = sorted({u for _, u, g, c, d in rows if g == f and u != t and (a <= c <= b or c <= a <= d)})
    got = I.corroborate(spark.createDataFrame(rows, "id int, tool string, file string, start_line int, end_line int")).collect()
    assert {r.id: r.corroborated_by for r in got} == want


def test_corroborate_by_matched_lines(spark):
    rows = [(1, "a", "f", 10, 12, [40, 41]), (2, "b", "f", 40, 40, None), (3, "c", "f", 90, 90, []), (4, "a", "f", 41, 41, None)]
    got = I.corroborate(spark.createDataFrame(rows, "id int, tool string, file string, start_line int, end_line int, match_lines array<int>")).collect()
    assert {r.id: r.corroborated_by for r in got} == {1: ["b"], 2: ["a"], 3: [], 4: []}


def test_signature_start(spark):
    lines = spark.createDataFrame([("f", 1, "}"), ("f", 2, "int"), ("f", 3, "g()"), ("f", 4, "{")], "file string, line_no int, line string")
    got = I.signature_start(lines, ["file"], F.col("line") == "}", F.col("line") == "{").collect()
    assert [(r.line_no, r.start_line) for r in got] == [(4, 2)]


def test_leaked_pairs_and_declared_splits(spark):
    pairs = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, None)], "pair int, commit string")
    kept, dropped = D.without_leaked_pairs(pairs, spark.createDataFrame([("c2",), (None,)], "commit string"), "commit")
    assert sorted(r.pair for r in kept.collect()) == [1, 3] and dropped.first()[0] == 2
    rows = spark.range(20).withColumn("split", F.lit("val"))
    digest = F.sha1(F.col("id").cast("string").cast("binary"))
    own = D.source_or_ratio_split(rows, "split", digest, ("id",)).collect()
    assert {(r.split, r.preserved) for r in own} == {("val", True)} and len(own) == 20
    mixed = D.source_or_ratio_split(rows.withColumn("split", F.when(F.col("id") > 0, F.col("split"))), "split", digest, ("id",)).collect()
    assert sorted(r.split for r in mixed) == ["test"] * 2 + ["train"] * 16 + ["val"] * 2 and not any(r.preserved for r in mixed)
    tiny = D.bootstrap_rows(spark)
    assert tiny.select("code").distinct().count() == tiny.count() == 12
    assert [D.artifact_kind(*x) for x in ((20, None), (21, 5), (None, 3), (None, 300), (None, None))] == ["bootstrap", "real", "bootstrap", "real", "unknown"]


def test_provenance_record(spark):
    rows = spark.createDataFrame([("abc", 1, "g"), ("d", 0, "g"), ("e", 0, "h"), ("f", 0, None)], "code string, label int, project string")
    files_ = spark.createDataFrame([("a.jsonl", "00", 4)], "path string, sha256 string, rows long")
    dropped = spark.createDataFrame([(6,)], "dropped_rows long")
    r = D.provenance_record(rows, "code", "label", "project", files_, {"max_rows": 9}, dropped, dataset="d", license="MIT").first()
    assert (r.dataset, r.license, r.n_rows, r.n_pos, r.bytes, r.per_group, r.caps.max_rows, r.dropped_rows, r.files[0].path) == ("d", "MIT", 4, 1, 6, {"g": 2, "h": 1}, 9, 6, "a.jsonl")


def test_pool_header_and_severity_counts(spark):
    samples = spark.createDataFrame([(1, "s1", "x", ["b", "a"], 2), (2, "s2", "y", ["a", "c"], 5), (3, "s3", None, None, None)], "seq int, sample string, subsystem string, checklist array<string>, n_findings int")
    r = V.pool_header(samples, ["subsystem"], "checklist", "seq").first()
    assert (r.subsystem, r.checklist, r.max_single) == ("x", ["b", "a", "c"], 5)
    f = spark.createDataFrame([("High",), ("odd",), (None,), ("",), ("info",), ("ART",)], "severity string")
    got = V.severity_counts(f).orderBy("place", "severity").collect()
    assert [(r.severity, r.n) for r in got] == [("high", 1), ("info", 1), ("?", 2), ("art", 1), ("odd", 1)]


def test_line_windows(spark):
    def loop(n, window, step):
        out, i = [], 0
        while n:
            out.append((i, min(n, i + window)))
            if i + window >= n:
                break
            i += step
        return out

    got = spark.range(40).select("id", I.line_windows(F.col("id").cast("int"), 12, 6).alias("w")).collect()
    assert {r.id: [tuple(w) for w in r.w] for r in got} == {n: loop(n, 12, 6) for n in range(40)}


def test_stratified(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "hard"]), rng.choice([0, 1, 1, 2])) for i in range(200)]
    quotas, cap = {1: 30, 0: 9}, 15
    queues = {}
    for i, g, y in rows:
        queues.setdefault((g, y), []).append(i)
    left, used, want = dict(quotas), {}, set()
    for lap in range(cap):
        for g in ("hard", "a", "b"):
            for y in (1, 0):
                q = queues.get((g, y), [])
                if lap < len(q) and left[y] > 0 and used.get(g, 0) < cap:
                    left[y] -= 1
                    used[g] = used.get(g, 0) + 1
                    want.add(q[lap])
    got = D.stratified(spark.createDataFrame(rows, "id int, g string, y int"), "g", "y", ["id"], quotas, cap, ["hard"])
    assert {r.id for r in got.collect()} == want


def test_budget_skips_and_goes_on(spark):
    rows = [(1, 1, 1, 50), (2, 1, 0, 40), (3, 2, 1, 200), (4, 3, 1, 5), (5, 4, 0, 5), (6, 5, 0, 5)]
    df = spark.createDataFrame(rows, "id int, pair int, y int, size int")
    got = D.budget_pick(df, F.lpad(F.col("id").cast("string"), 3, "0"), ["id"], "size", "pair", "y", 4, 105, max_share=0.7)
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budget_against_a_plain_fold(spark, seed):
    """More units than a block holds, large ones and one label first."""
    import random

    rng = random.Random(seed)
    rows = [(i, i // 2 if i < 60 else i, i % 2 if i < 60 else int(i < 140 or rng.random() < 0.5), rng.choice([30, 60, 90] if i % 60 < 40 else [1, 2, 9])) for i in range(200)]
    most, room, counts, used, want = 14, 150, {0: 0, 1: 0}, 0, set()
    units = {}
    for i, unit, y, n in rows:
        units.setdefault(unit, []).append((i, y, n))
    for unit in sorted(units.values(), key=lambda u: (len(u) == 1, u[0][0])):
        size, after = sum(n for _, _, n in unit), dict(counts)
        for _, y, _ in unit:
            after[y] += 1
        if sum(after.values()) <= most and used + size <= room and (len(unit) > 1 or not want or after[unit[0][1]] / sum(after.values()) <= 0.62):
            counts, used, want = after, used + size, want | {i for i, _, _ in unit}
    df = spark.createDataFrame(rows, "id int, pair int, y int, size int")
    got = D.budget_pick(df, F.lpad(F.col("id").cast("string"), 3, "0"), ["id"], "size", "pair", "y", most, room, reach=1)
    assert {r.id for r in got.collect()} == want


def test_picks_of_the_queries_against_plain_folds(spark):
    """The registered round robin and budgeted pick over a driver table, in plain Python."""
    import hashlib

    from sievework.plans.datasets import budget_pick, stratified_round_robin

    path = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect() if r.doc_id in quality}
    queues, left, used, want = {}, {1: 60, 0: 30}, {}, set()
    for i in sorted(docs):
        queues.setdefault((docs[i].lang, quality[i]), []).append(i)
    langs = ["es", "fr", *sorted({lang for lang, _ in queues if lang is not None} - {"es", "fr"})]
    for lap in range(25):
        for lang in langs:
            for y in (1, 0):
                q = queues.get((lang, y), [])
                if lap < len(q) and left[y] > 0 and used.get(lang, 0) < 25:
                    left[y], used[lang] = left[y] - 1, used.get(lang, 0) + 1
                    want.add(q[lap])
    assert want and {r.doc_id for r in stratified_round_robin(spark, path).where("lang is not null").collect()} == want

    units = {}
    for i, d in docs.items():
        size = len(json.dumps({"doc_id": i, "text": d.text}, ensure_ascii=False).encode()) + 1
        units.setdefault(i // 2, []).append((hashlib.sha1(str(i).encode()).hexdigest(), i, quality[i], size))
    picked, counts, room = set(), {0: 0, 1: 0}, 120_000
    for unit in sorted(units.values(), key=lambda u: (len(u) == 1, min(u)[0])):
        size = sum(n for *_, n in unit)
        fits = len(picked) + len(unit) <= 80 and size <= room
        if fits and (len(unit) > 1 or not picked or (counts[unit[0][2]] + 1) / (len(picked) + 1) <= 0.62):
            room -= size
            for y in (1, 0) if len(unit) > 1 else (unit[0][2],):  # a pair is one of each
                counts[y] += 1
            picked |= {i for _, i, _, _ in unit}
    assert picked and {r.doc_id for r in budget_pick(spark, path).collect()} == picked


def test_guards(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, y int")
    with pytest.raises(PySparkException):
        D.balanced(df, "y", F.sha1(F.col("id").cast("string").cast("binary")), ("id",), 4).collect()
    with pytest.raises(ValueError):
        D.balanced(df, "y", F.lit("x"), ("id",), 3)
    with pytest.raises(PySparkException):
        D.guard_rows(df, 4).collect()
    assert D.guard_rows(df, 3).count() == 3


def test_splits(spark):
    df = spark.range(1003).withColumn("h", F.sha1(F.col("id").cast("string").cast("binary")))
    counts = {r.split: r["count"] for r in D.ratio_split(df, F.col("h"), ("id",)).groupBy("split").count().collect()}
    assert counts == {"train": 802, "val": 100, "test": 101}
    for n, val in ((0, 0), (1, 0), (2, 1), (25, 2)):
        out = D.guarded_val_split(df.limit(n), F.col("h"), ("id",))
        assert out.where("split = 'val'").count() == val
    names = spark.createDataFrame([("x_Train.jsonl",), ("valid.jsonl",), ("latest.jsonl",), ("data.jsonl",)], "n string")
    assert [r[0] for r in names.select(D.split_of_file(F.col("n"))).collect()] == ["train", "val", "test", None]


def test_pairs(spark):
    rows = [(0, "a", 1), (1, "a", 0), (2, "b", 0), (3, "b", 1), (4, "c", 1), (5, "d", 0), (6, "e", 1)]
    got = D.adjacent_pairs(spark.createDataFrame(rows, "pos int, c string, y int"), "pos", "c", "y").collect()
    assert {r.pair: r.well_formed for r in got} == {0: True, 1: False, 2: False}


@pytest.mark.parametrize("case", ["ties", "one label", "empty"])
def test_areas(spark, case):
    rng = random.Random(5)
    rows = [] if case == "empty" else [(round(rng.random(), 1), 1 if case == "one label" else rng.randrange(2)) for _ in range(80)]
    r = M.areas(spark.createDataFrame(rows, "score double, label int")).first()
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    if not pos or not neg:
        assert r.roc_auc is None and r.pr_auc is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert r.roc_auc == pytest.approx(wins / len(pos) / len(neg))
    ap = sum(sum(1 for p in pos if p == t) / len(pos) * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(n >= t for n in neg)) for t in set(pos))
    assert r.pr_auc == pytest.approx(ap)


def test_published_confusion_counts_give_the_published_rates(spark):
    r = M.rates(spark.createDataFrame([(715, 703, 311, 30981)], "tp long, fp long, fn long, tn long")).first()
    assert [round(x, 3) for x in (r.precision, r.recall, r.f1, r.accuracy)] == [0.504, 0.697, 0.585, 0.969]


def test_greedy_match(spark):
    rng = random.Random(6)
    pairs = [("g", r, c, round(rng.random(), 2)) for r in range(8) for c in range(8)]
    used, want = set(), []
    for r in range(8):
        best = max(((s, -c) for _, q, c, s in pairs if q == r and s >= 0.5 and c not in used), default=None)
        if best:
            used.add(-best[1])
            want.append((r, -best[1]))
    got = V.greedy_match(spark.createDataFrame(pairs, "g string, ref_seq int, cand_seq int, sim double"), ["g"])
    assert sorted((r.ref_seq, r.cand_seq) for r in got.collect()) == want


def test_near_copies_flag_both_sides(spark):
    a, b, c = "abcdefghij", "abcdefghxy", "zzcdefghxy"  # a ~ b, b ~ c, not a ~ c
    rows = [("g", 0, a), ("g", 1, b), ("g", 2, c), ("h", 0, a), ("h", 1, c), ("h", 2, b)]
    got = V.near_duplicates(spark.createDataFrame(rows, "g string, seq long, t string"), ["g"], "seq", "t", 0.8).collect()
    assert {(r.g, r.seq): (r.duplicate_of, r.flagged) for r in got} == {("g", 0): (None, True), ("g", 1): (0, True), ("g", 2): (1, True), ("h", 0): (None, True), ("h", 1): (None, False), ("h", 2): (0, True)}


def test_near_copies_of_whole_texts_against_a_plain_fold(spark, tmp_path):
    import difflib
    import re

    from sievework.plans.reviews import near_dup_narratives

    head, tail = "abcdefghij" * 45, "ghijklmnop" * 120 + "q" + "rstuvw" * 200
    rows = [(1, 0, head + tail), (1, 1, head + "0123456789" * 120), (1, 2, "x" * 400 + "z" + tail), (1, 3, "y" * 400 + "1" + tail)]
    rows += [(2, 0, "abcdefghij"), (2, 1, "abcdefghxy"), (2, 2, "zzcdefghxy"), (2, 3, "ABC-DEF? GHXY"), (2, 4, "abc/def! ghxy"), (3, 0, None), (3, 1, "?!"), (3, 2, "?!")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'user' as role").write.parquet(f"{tmp_path}/conversations.parquet")
    normed = {(c, t): re.sub(r"[^a-z0-9 ]+", " ", (x or "").lower()) for c, t, x in rows}
    want = {}
    for (c, t), x in normed.items():
        earlier = [s for (d, s), y in normed.items() if d == c and s < t and x.strip() and y.strip() and difflib.SequenceMatcher(None, y, x).ratio() >= 0.8]
        want[c, t] = min(earlier, default=None)
    assert want[1, 1] is None and want[1, 3] is not None and want[2, 2] == 1
    flagged = {k for k, v in want.items() if v is not None} | {(c, v) for (c, _), v in want.items() if v is not None}
    got = near_dup_narratives(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): r.duplicate_of for r in got} == want and {(r.conv_id, r.turn) for r in got if r.flagged} == flagged


def test_near_copies_on_a_driver_table(spark):
    import difflib
    import re

    from sievework.plans.reviews import near_dup_narratives

    path = "/root/testdata/sf0.01"
    texts = {(r.conv_id, r.turn): re.sub(r"[^a-z0-9 ]+", " ", r.text.lower()) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()}
    for r in near_dup_narratives(spark, path).where("conv_id % 4 = 0").collect():  # every fourth conversation keeps the test short
        own = texts[r.conv_id, r.turn]
        near = [t for (c, t), x in texts.items() if c == r.conv_id and t < r.turn and own.strip() and x.strip() and difflib.SequenceMatcher(None, x, own).ratio() >= 0.8]
        assert r.duplicate_of == min(near, default=None)


def test_greedy_match_on_a_driver_table(spark):
    from sievework.plans.reviews import finding_similarity, greedy_match

    path = "/root/testdata/sf0.01"
    taken, want = {}, set()
    for r in sorted(finding_similarity(spark, path).collect(), key=lambda r: (r.conv_id, r.ref_seq, -r.sim, r.cand_seq)):
        if ("ref", r.conv_id, r.ref_seq) not in taken and ("cand", r.conv_id, r.cand_seq) not in taken:
            taken["ref", r.conv_id, r.ref_seq] = taken["cand", r.conv_id, r.cand_seq] = True
            want.add((r.conv_id, r.ref_seq, r.cand_seq))
    assert want and {(r.conv_id, r.ref_seq, r.cand_seq) for r in greedy_match(spark, path).collect()} == want


def test_anchor_rules_differ(spark):
    df = spark.createDataFrame([("a", "clean", 1), ("a", "finding", 2), ("a", "finding", 3), ("b", "clean", 4)], "k string, d string, seq int")
    assert sorted(r.seq for r in V.anchors(df, ["k"], "d", "seq").collect()) == [2, 4]
    assert sorted(r.seq for r in V.anchors(df, ["k"], "d", "seq", later_finding_wins=True).collect()) == [3, 4]


def test_floor(spark):
    f = spark.createDataFrame([(["x"], 0.9, "low", False), ([], 0.9, "low", False), (["x"], 0.5, "high", None)], "matched_patterns array<string>, score double, severity string, is_vulnerable boolean")
    got = V.corroboration_floor(f.withColumn("explanation", F.lit("Said."))).collect()
    assert [(r.is_vulnerable, r.severity, r.downgrade_blocked) for r in got] == [(True, "medium", True), (False, "low", False), (None, "high", False)]
    assert got[0].explanation == "Said. [cross-check] Score 0.90 >= 0.80 and rules matched [x]; a downgrade was overridden." and got[1].explanation == "Said." and got[1].cross_check is None


def test_order_is_kept_and_failures_fall_back(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "seq int, v string").repartition(5)
    got = M.map_in_order(rows, "seq", "v", lambda: lambda v: str(100 // (int(v) % 7)), lambda v: f"no {v}").collect()
    assert [(r.seq, r.result, r.failed) for r in got] == [(i, f"no {i}" if i % 7 == 0 else str(100 // (i % 7)), i % 7 == 0) for i in range(50)]
    scores = rows.select("seq", M.score_texts(F.when(F.col("seq") != 3, F.col("v")), lambda: lambda texts: [float(len(t)) for t in texts], batch=4).alias("s")).collect()
    assert {r.seq: r.s for r in scores} == {i: None if i == 3 else float(len(str(i))) for i in range(50)}


def test_top_scores_and_places(spark):
    f = spark.createDataFrame([("b", 2, 0.5, 0), (None, None, None, 1), ("a", None, 0.9, 2), ("b", 1, 0.5, 3)], "file string, start_line int, score double, seq int")
    assert [r.seq for r in P.top_scores(f, 2, "seq").collect()] == [2, 0] and [r.seq for r in P.top_scores(f, 0, "seq").collect()] == [2, 0, 3, 1]
    assert [r.seq for r in P.by_place(f).collect()] == [1, 2, 3, 0]
    assert f.select(P.first_lines(F.lit("a\nb\nc"), 2)).first()[0] == "a\nb" and f.select(P.first_present(f, ["none", "file", "seq"])).collect()[1][0] == "1"
    manifest = spark.createDataFrame([("r1", "x.c"), ("r1", "y.c")], "review string, path string")
    assert sorted((r.review, str(r.path)) for r in P.with_sources(spark.createDataFrame([("r1",), ("r2",)], "review string"), manifest).collect()) == [("r1", "x.c"), ("r1", "y.c"), ("r2", "None")]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(X.language_of_path(F.lit(p))) for p in ("a.CC", "b.h", "c.c", "d.inl", "e", ".cpp", "x.d/y")] == ["cpp", "cpp", "c", "cpp", "c", "c", "c"]
    assert value(X.strip_fences(F.lit("```json\n{}\n```"))) == "{}" and value(X.strip_fences(F.lit(" x "))) == "x"
    assert value(X.footprint_gb(F.lit(4.0), F.lit(0.5), F.lit(8.0))) == 8.0
    assert value(X.normal_path(F.lit(".//a/./b\\c/"))) == "a/b/c" and value(X.basename(F.lit("a/b.c"))) == "b.c"


def test_unicode_space(spark):
    rows = spark.createDataFrame([("a\u00a0\u2003b\u0085c\u2028d \x1c e",)], "t string")
    assert rows.select(X.collapse_space(F.col("t"))).first()[0] == "a b c d e"


def test_sources(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/X.CPP").write_bytes(b"int a\xff;")
    (tmp_path / "src/b.h").write_text("int b;")
    (tmp_path / "src/test_c.c").write_text("gets(x);")
    (tmp_path / "src/readme.md").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.list_sources(spark, str(tmp_path / "src"), exclude="test_*").collect()}
    assert got == {"X.CPP": "int a;", "b.h": "int b;"}
    assert [r.path.rsplit("/", 1)[1] for r in files.list_sources(spark, str(tmp_path / "src")).collect()] == ["X.CPP", "b.h", "test_c.c"]
    assert files.list_sources(spark, str(tmp_path / "src/readme.md")).first().text == "no"
    assert files.list_sources(spark, str(tmp_path / "src"), exclude="*").count() == 0
    (tmp_path / "x.jsonl").write_bytes(b'{"a":1}\n{"a":2}')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "y.jsonl").write_bytes(b'{"a":1}\n\xff\n')
    assert [files.file_provenance(spark, str(tmp_path / n)).first().rows for n in ("x.jsonl", "y.jsonl")] == [2, 2]
    assert files.file_provenance(spark, str(tmp_path / "empty.jsonl")).count() == 0
    (tmp_path / "kb.json").write_text(json.dumps({"entries": [{"id": "k", "triggers": ["GETS", "x y"], "note": "n"}, {"id": "q", "triggers": None}]}))
    (tmp_path / "bad.json").write_text('{"entries": [')
    kb = files.read_kb(spark, str(tmp_path / "kb.json"))
    assert [r.ids for r in files.match_kb(spark.createDataFrame([("call gets(",), (None,), ("a",)], "text string"), kb).collect()] == [["k"], [], []]
    assert files.read_kb(spark, str(tmp_path / "bad.json")).count() == files.read_kb(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "set.json").write_text('{"threshold": 0.7, "window": null, "name": "n"}')
    defaults = {"threshold": 0.5, "window": 12, "name": "d", "more": True}
    assert files.read_settings(spark, str(tmp_path / "set.json"), defaults) == {"threshold": 0.7, "window": 12, "name": "n", "more": True}
    assert files.read_settings(spark, str(tmp_path / "none.json"), defaults) == defaults
    grouped = {r.lang: [p.rsplit("/", 1)[1] for p in r.paths] for r in files.by_language(files.list_sources(spark, str(tmp_path / "src"))).collect()}
    assert grouped == {"cpp": ["X.CPP", "b.h"], "c": ["test_c.c"]}
    m = files.manifest(spark, str(tmp_path / "src"))
    assert m.count() == 4 and files.verify_manifest(m, m.where("bytes > 6")).where("status = 'missing'").count() == 2
    (tmp_path / "rows_train.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    rows = files.read_shards(spark, str(tmp_path / "rows_train.jsonl"), "a int")
    assert [(r.a, r.split) for r in rows.orderBy("seq").collect()] == [(1, "train"), (2, "train")]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "rows_train.jsonl"), "a int", strict=True).collect()
    (tmp_path / "doc.json").write_text(json.dumps({"explanations": [], "findings": [{"file": "f.c", "start_line": 3}]}))
    assert [r.file for r in files.read_findings(spark, str(tmp_path / "doc.json")).collect()] == ["f.c"]
    (tmp_path / "t.csv").write_text('File,Line,Level,Name,Warning\nf.c,3,4,strcpy,"a, b"\nf.c,x,1,y,z\n')
    assert [(r.start_line, r.severity) for r in files.read_csv_findings(spark, str(tmp_path / "t.csv"), "t").collect()] == [(3, "high"), (0, "low")]
    odd = spark.createDataFrame([("a.c:1:2: warning: m [x/y z+]",)], "line string")
    assert files.parse_log_lines(odd, "tidy").first().rule == "x/y z+"
    log = spark.createDataFrame([("a/b.c:12:5: warning: bad thing [x-y.z]",), ("c:\\d.c:7:1: error: oops",), ("note: no",), ("a.c:1:2: note: n",)], "line string")
    assert [(r.file, r.start_line, r.rule, r.severity, r.issue) for r in files.parse_log_lines(log, "tidy").collect()] == [("a/b.c", 12, "x-y.z", "medium", "bad thing"), ("c:\\d.c", 7, "tidy", "high", "oops")]
    tab = spark.createDataFrame([("a.c\t3\tError\tid\tmsg",), ("a.c\tx\tError\tid\tmsg",), ("a\tb",)], "line string")
    assert files.parse_tab_output(tab, "t").count() == 1
    asked = spark.createDataFrame([("./src/a.c",), ("a.c",), ("q.c",)], "file string")
    paths = spark.createDataFrame([("src/a.c",)], "path string")
    assert {r.file: r.path for r in files.resolve_sources(asked, paths).collect()} == {"./src/a.c": "src/a.c", "a.c": "src/a.c", "q.c": None}
    entries = spark.createDataFrame([("/etc/x",), ("a/../b",), ("a/b..c",), ("ok",)], "path string")
    assert sorted(r.path for r in files.unsafe_entries(entries).collect()) == ["/etc/x", "a/../b"]


def test_sinks(spark, tmp_path):
    rows = [("b.c", 5, 9, 0.9, "Bad <copy>", "CWE-120", "high", "strcpy", "t", [7, 99], True, 2), ("a\\x.c", 1, None, 0.5, None, None, "odd", "gets", "t", None, None, 1), ("c.c", 1, 1, 0.1, "no", None, "low", "gets", "t", None, False, 3)]
    f = spark.createDataFrame(rows, files.FINDING + ", seq int")
    doc = json.loads(sinks.sarif_document(f).first().value)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["ruleId"] for r in run["results"]] == ["gets", "strcpy"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["gets", "strcpy"]
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 7, "endLine": 9}
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/x.c" and run["results"][0]["level"] == "warning"
    assert "&lt;copy&gt;" in "".join(sinks.html_report(f, "T")) and list(sinks.markdown_report(f, "T"))[1].startswith("- **high** b.c:5")
    sinks.write_document(sinks.findings_document(f, threshold=0.5), str(tmp_path / "doc"))
    assert len(json.loads(spark.read.text(str(tmp_path / "doc")).first().value)["findings"]) == 3
    sinks.write_jsonl(f.select("file", "cwe"), str(tmp_path / "l"))
    assert '"cwe":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "l")).collect())
    sinks.write_blind_split(f.select("seq", F.col("issue").alias("code"), "severity", F.lit("eval").alias("split")), str(tmp_path / "blind"), "seq", "code", ["severity"], "split")
    assert spark.read.parquet(str(tmp_path / "blind/corpus")).columns == ["opaque_id", "code", "split"]
    with pytest.raises(PySparkException, match="more than 2"):
        sinks.findings_document(f, most=2).collect()
    with pytest.raises(PySparkException, match="more than 1"):
        sinks.sarif_document(f, most=1).collect()
    docs = spark.createDataFrame([(2, None, [("b", 1)]), (1, "m", [("a", 1), ("a", 2)]), (3, "n", None)], "ord int, meta string, findings array<struct<file:string, line:int>>")
    one = files.merge_documents(docs).first()
    assert one.meta == "m" and [(x.file, x.line) for x in one.findings] == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(PySparkException, match="more than 2"):
        files.merge_documents(docs, most=2).collect()
    told = f.select("*", F.lit("does").alias("what_code_does"), F.lit(" ").alias("vulnerability"), F.lit("does").alias("explanation"), F.lit("do x").alias("fix"))
    assert told.select(sinks.narrative(told)).first()[0] == "Bad <copy>\n\nWhat the code is doing: does\n\nFix: do x"
    review = {"subsystem": "net", "what_the_code_does": "It reads.", "what_could_go_wrong": [{"explanation": "overflow", "file": "a.c", "lines": "3-4", "code": "x\n"}], "findings": [{"title": "T", "severity": "high", "file": "a.c", "line": "3", "flags": ["copied narrative"]}], "reviewed_anchors": [{"anchor": "f()", "disposition": "dismissed", "reason": "bounded"}], "audit_checklist": ["lengths"], "suppressed_findings": [{"title": "S", "suppressed": "key"}]}
    lines = list(sinks.review_markdown(review))
    assert lines[0] == "# Review of net" and "1. overflow (a.c:3-4)" in lines and "- f(): dismissed - bounded" in lines and "- [ ] lengths" in lines and "- flagged: copied narrative" in lines and "- S: key" in lines
    assert sinks.empty_findings(spark).count() == 0
    assert [r.status for r in sinks.lane_status([("a", True, True), ("b", True, False), ("c", False, False)], spark).collect()] == ["ok", "failed", "skipped"]


def test_stream_counts_hours(spark):
    from sievework.streaming.scan import hourly_counts

    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/events.parquet*")
    q = hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly_counts(events).collect()))


def test_stream_gives_the_rows_of_the_batch(spark):
    from sievework.streaming.scan import scan_stream

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet(f"{path}/documents.parquet*")
    q = scan_stream(stream, "doc_id").writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["doc_id", "line_no", "rule"]
    assert sorted(map(tuple, spark.table("hits").select(key).collect())) == sorted(map(tuple, scan_stream(docs, "doc_id").select(key).collect()))


def test_findings_leave_their_code_behind_when_told(spark):
    from sievework.operators import rules

    files = spark.createDataFrame([("a.c", "void f(char *s) {\n  gets(s);\n}\n/* long */\n"), ("b.c", "int a;"), ("c.c", None)], "path string, text string")
    with_code, without = rules.scan_findings(files), rules.scan_findings(files, snippet=False)
    assert [r["snippet"] for r in with_code.collect()] == ["void f(char *s) {\n  gets(s);\n}"] and [r["snippet"] for r in without.collect()] == [None]
    assert with_code.drop("snippet").collect() == without.drop("snippet").collect() and rules.explained(with_code).drop("snippet").collect() == rules.explained(without).drop("snippet").collect()


@pytest.mark.parametrize("name", ["code_findings", "explained_findings"])
def test_queries_that_read_no_code_ask_for_none(spark, monkeypatch, name):
    from sievework.operators import rules
    from sievework.plans import code

    asked, real = [], rules.scan_findings
    monkeypatch.setattr(rules, "scan_findings", lambda *a, **k: asked.append(k.get("snippet", True)) or real(*a, **k))
    getattr(code, name)(spark, "/root/testdata/sf0.001")
    assert asked == [False]
