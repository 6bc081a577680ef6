"""Rule scan of a stream of texts. Scanning keeps no state, so a stream gives the rows that the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.intervals import lines_of
from sievework.operators.rules import scan_lines


def scan_stream(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return scan_lines(lines_of(texts, text, [key])).select(key, "line_no", "rule", "cwe", "severity")


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Findings by tool and hour of their time, with a watermark for late ones. Times may be with or without a zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
