import importlib.util
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from test_decontam import brute_force as contained
from test_neardup import brute_force as groups
from test_substring import brute_force as kept_words
from tokenizers import Tokenizer

from sievework.llm import bpe

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, sf_dir, tmp_path):
    import corpus_pipeline

    out = [docs]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/stage{i}")
        out.append(spark.read.parquet(f"{tmp_path}/stage{i}"))
    return out


@pytest.mark.parametrize("name", ["sf0.001"])
def test_every_stage_on_the_driver_tables(spark, tmp_path, name):
    path = f"/root/testdata/{name}"
    out = staged(spark, spark.read.parquet(f"{path}/documents.parquet"), path, tmp_path)
    rows = [[r.asDict() for r in df.collect()] for df in out]
    for df in out[1:5]:
        assert df.columns == COLUMNS
    langs = {r["doc_id"]: r["lang"] for r in rows[0]}
    assert len(rows[1]) >= 0.97 * len(rows[0])
    assert sum(r["lang"] == langs[r["doc_id"]] for r in rows[1]) >= 0.97 * len(rows[1])
    want = groups([(r["doc_id"], r["text"]) for r in rows[1]])
    assert {r["doc_id"] for r in rows[2]} == {i for i, (_, c) in want.items() if i == c}
    want = kept_words([(r["doc_id"], r["text"]) for r in rows[2]])
    for r in rows[3]:
        assert " ".join(r["text"].split()) == want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    gone = {d for d, *_ in contained([(r["doc_id"], r["text"]) for r in rows[3]], items)}
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in rows[3]} - gone
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_edges(spark, tmp_path):
    rng = random.Random(1)
    words = ["garden", "house", "river", "stone", "winter", "morning", "letter", "window", "bridge", "summer"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(60), "en", "s", 1) for i in range(30)]
    rows += [(i, " ".join(rng.choice(["garten", "haus", "fluss", "stein", "morgen", "brief"]) for _ in range(60)), "de", "s", 1) for i in range(40, 60)]
    rows += [(70, None, "en", None, None), (71, "", None, "s", 0), (72, text(3000), None, "s", 1), (5, rows[5][1], "en", "s", 1), (None, text(40), None, None, None)]
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = staged(spark, docs, str(tmp_path), tmp_path)
    ids = [r.doc_id for r in out[-1].collect()]
    assert ids.count(5) == 1 and 70 not in ids and 71 not in ids and 3 not in ids and 72 in ids
    (tmp_path / "more").mkdir()
    spark.createDataFrame([(1, " ".join(f"benchmark{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/more/benchmark.parquet")
    item = " " + " ".join(f"benchmark{i}" for i in range(20)) + " "
    again = rows + [(None, text(60) + item, "en", None, None), (2, text(60) + item, "en", "s", 1), (2, text(70), "en", "t", 1), (2, text(70), "en", "t", 1), (90, text(120_000), "en", "s", 1)]
    more = staged(spark, spark.createDataFrame(again, docs.schema).selectExpr("*", "1 as row", "2 as parts", "'x' as found", "3 as least"), str(tmp_path / "more"), tmp_path / "more")
    for df in more[1:5]:
        assert df.columns == COLUMNS
    kept = more[2].collect()
    assert [r.doc_id for r in kept].count(2) == 1 and len([r for r in kept if r.doc_id is None]) == 2
    least = min((r for r in more[1].collect() if r.doc_id == 2), key=lambda r: r.text)
    assert next(r for r in kept if r.doc_id == 2).text == least.text  # of unequal rows with one id the least text
    left = more[4].collect()
    assert not any("benchmark3" in r.text for r in left) and len([r for r in left if r.doc_id is None]) == 1 and 90 in [r.doc_id for r in left]
    empty = staged(spark, docs.limit(0), str(tmp_path), tmp_path / "empty")
    assert empty[-1].count() == 0


def test_entry_runs_the_same_stages(spark):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import __spark_entry__

    path = "/root/testdata/sf0.001"
    out = __spark_entry__.queries()["pipeline"](spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 100 < out.count() <= 200
