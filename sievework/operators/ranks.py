"""Global ranks and prefix sums without a global sort: buckets first, their offsets from one small table, then ranks inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a hash are its first hex digits: 3 make 4,096, each with that share of any input.
HASH_DIGITS = 3


def hash_rank(df: DataFrame, digest: Column, by: tuple[str, ...] = (), tie: tuple[str, ...] = (), digits: int = HASH_DIGITS) -> DataFrame:
    """``df`` with ``rank`` (1, 2, ... in the order of ``digest``, then ``tie``, within ``by``) and ``total`` (rows within ``by``).

    No task gets more than its buckets; only the counts by bucket meet in one place.
    """
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    counts = counts.select(*by, "_bucket", (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_digest", *tie)
    ranked = rows.withColumn("_place", F.row_number().over(inside)).join(counts, [*by, "_bucket"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_place")).drop("_digest", "_bucket", "_before", "_place")


def running_sums(df: DataFrame, key: Column, bucket: Column, sums: dict[str, str]) -> DataFrame:
    """For a table of one row a key: for each (name, column) of ``sums`` the sum over all rows of greater key, in two levels.

    ``bucket`` must be monotonous in ``key`` and take few values.
    """
    rows = df.withColumn("_key", key).withColumn("_bucket", bucket)
    level = rows.groupBy("_bucket").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    level = level.select("_bucket", *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_above_{n}") for n in sums])
    within = Window.partitionBy("_bucket").orderBy(F.desc("_key")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_within_{n}") for n, c in sums.items()])
    out = rows.join(level, "_bucket")
    return out.select(*df.columns, *[(F.col(f"_above_{n}") + F.col(f"_within_{n}")).alias(n) for n in sums])
