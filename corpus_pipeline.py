"""Corpus pipeline: language ID, near-duplicates, substring deduplication, decontamination and encoding, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``. Every stage reads all that the one before kept.

Edge cases: rows with equal doc_id share the verdict of the near-duplicate stage on that doc_id, and only one of them, the least by
text and then the other columns, stays after it; a null doc_id is never dropped as a copy; the other stages judge each row by itself,
whatever its doc_id; texts that lose all their words stay, as empty ones; columns beside those of ``documents`` go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, decontam, langid, neardup, substring
from sievework.llm.staging import mark, release, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted beyond doubt; lang becomes the prediction."""
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    out = docs.select(*COLUMNS, langid.language_of(F.col("text"), model).alias("found")).where("found.accepted")
    return out.select("doc_id", "text", F.col("found.lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id."""
    gone = stage(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    kept = neardup.by_ids(docs.select(COLUMNS), gone, "doc_id", "left_anti")
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    one = neardup.by_ids(kept, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("least")).select("doc_id", "least.*")
    return neardup.by_ids(kept, repeated, "doc_id", "left_anti").unionByName(one)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier in the corpus."""
    cut = substring.remove_repeats(docs, carry=["lang", "source"])
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.without_contained(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text decoded from them."""
    out = bpe.encode_decode(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: The stages learn, hash and match in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = mark()
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            used = mark()
            docs = stage(docs, f"pipeline-{i}")
            release(before, used)  # what the stage wrote on its way, and its input
            before = mark() - 1
    return docs
