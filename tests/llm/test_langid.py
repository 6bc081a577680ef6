import zlib

from pyspark.sql import functions as F

from sievework.llm import langid
from sievework.llm.queries import op1_langid


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = op1_langid(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right / total >= 0.97, right / total


def test_edges(spark, tmp_path):
    rows = [(i, t * 20, lang, "s") for i, (t, lang) in enumerate([("the house and the garden are here ", "en"), ("das haus und der garten sind hier ", "de"), ("und so weiter ", None)] * 30)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 _ !!", "de", "s"), (None, "the house", "en", "s"), (903, "the garden " * 200_000, "en", "s"), (904, "DER GARTEN UND DAS HAUS", None, "s")]
    rows += [(904, "DER GARTEN UND DAS HAUS", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_langid(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert got[903].lang_pred == got[None].lang_pred == "en" and got[904].lang_pred == "de" and not got[None].held_out


def test_against_a_plain_loop(spark):
    """Every document of a driver table, predicted by the model's own dictionaries one text after another, without the module's classifier."""
    import re

    import zstandard

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    order = sorted(model, key=lambda lang: (-model[lang][0], lang))

    def size(data, block):
        made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=6, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op1_langid(spark, path).collect():
        words = re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        parts = [" ".join(dict.fromkeys(words[i : i + 500])).encode() for i in range(0, len(words), 500)]
        if not parts:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        sums = [sum(size(model[x][1][0], p) for p in parts) for x in order]
        margin = lambda s: 1 - sorted(s)[0] / sorted(s)[1]
        if margin(sums) < 0.03:
            sums = [s + sum(size(d, p) for d in model[x][1][1:] for p in parts) for s, x in zip(sums, order)]
        assert (r.lang_pred, r.score, r.accepted) == (order[sums.index(min(sums))], margin(sums), margin(sums) >= 0.002)


def test_whole_training_texts_are_learned(spark):
    """Words far behind in a long line and a long text count as those at its head do."""
    rare = {"aa": "zylphq wortex brimbal", "bb": "koffin drustel makvor"}
    rows = [(f"{lang}{i % 3} " + " ".join(f"common{j}" for j in range(400 + i)) + f" {rare[lang]}", lang) for lang in rare for i in range(20)]
    rows += [("\n".join(f"line{j}" for j in range(500)) + f"\n{rare[lang]}", lang) for lang in rare]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert all(all(w.encode() in model[lang][1][0] for w in words.split()) for lang, words in rare.items())


def test_clashing_columns_and_an_empty_query_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the house", "en", "x"), (2, "das haus", "de", "y")], "doc_id int, text string, lang string, found string")
    docs.selectExpr("*", "1 as held_out", "2 as accepted", "3 as key", "4 as segment", "5 as place").write.parquet(f"{tmp_path}/documents.parquet")
    assert op1_langid(spark, str(tmp_path)).columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and op1_langid(spark, str(tmp_path)).count() == 2
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op1_langid(spark, f"{tmp_path}/none").count() == 0


def test_narrow_margins_are_not_accepted():
    own = langid.Classifier({"en": (2, [b"the house and the garden " * 50] * 4), "xx": (1, [b"the house and the garden " * 50] * 4)})
    assert own.predict("the house") == ("en", 0.0)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id int, text string, lang string")
    assert langid.fit(docs) == {}
    assert langid.predict(docs, {}).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), {}).count() == 0
