"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, license, lmscore, neardup, quality, substring, urlfilter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = pages.select(F.struct("page_id", "url").alias("key"), "html")
    return html.extract(source, id_col="key").select("key.page_id", "key.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document, with those labelled as good for the target."""
    wanted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return lmscore.score(documents(spark, sf_dir), wanted)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    return license.scan(documents(spark, sf_dir))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists as they stood when it was fetched. The table has no time of fetch: page_id stands
    for it, as the day of 2024 that it is modulo 366."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 366 as int))").cast("timestamp")
    return urlfilter.evaluate(pages.withColumn("fetched", day), urlfilter.listed_entries(spark))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and the digest of what is left of every document after substring deduplication."""
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict for every document."""
    return quality.rate(documents(spark, sf_dir))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontam.find_contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    out = bpe.encode_decode(documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_html": op2_html,
    "op3_lmscore": op3_lmscore,
    "op4_license": op4_license,
    "op5_neardup": op5_neardup,
    "op6_urlfilter": op6_urlfilter,
    "op7_substring": op7_substring,
    "op8_quality": op8_quality,
    "op9_decontam": op9_decontam,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op4_license": license.ORACLE,
    "op6_urlfilter": urlfilter.ORACLE,
    "op8_quality": quality.ORACLE,
}
