"""Labelled datasets: deduplication, leakage filters, splits, balanced, stratified and budgeted samples, provenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.ranks import hash_rank


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in ``order``; null keys are equal. The order is compared in partial aggregates, not sorted."""
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return out.select("_row.*")


def dedup_by_digest(df: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """The first row of each digest, with how many rows it stands for and how many labels they had, if there is a label column."""
    rows = df.withColumn("digest", digest)
    labels = [F.count_distinct("label").alias("n_labels")] if "label" in df.columns else []
    out = rows.groupBy("digest").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("n_rows"), *labels)
    return out.select("_row.*", "digest", "n_rows", *(["n_labels"] if labels else []))


def without_leaks(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the index. Null keys stay."""
    return df.join(index.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def without_leaked_pairs(pairs: DataFrame, index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pairs, a row each, whose key is not in the index, and one row of counts: dropped_rows, two a pair. Null keys stay."""
    kept = without_leaks(pairs, index, key)
    known = index.select(key).where(F.col(key).isNotNull()).distinct()
    return kept, pairs.join(known, key, "left_semi").agg((F.count(F.lit(1)) * 2).alias("dropped_rows"))


def source_or_ratio_split(df: DataFrame, split: str, digest: Column, tie: tuple[str, ...]) -> DataFrame:
    """The splits that the rows declare if every row does, else 80/10/10 by hash; preserved says which."""
    own = declared_splits(df, split).withColumnRenamed(split, "_declared")
    out = ratio_split(own, digest, tie)
    return out.select("*", F.col("all_declared").alias("preserved")).withColumn("split", F.when(F.col("all_declared"), F.col("_declared")).otherwise(F.col("split"))).drop("_declared", "all_declared")


def bootstrap_rows(spark: SparkSession) -> DataFrame:
    """A tiny dataset to try a training run with (code, label, split): no text stands in two splits."""
    rows = [(f"int f{i}(char *s) {{ char b[{8 + i}]; {'strcpy(b, s)' if y else f'snprintf(b, sizeof b, {chr(34)}%s{chr(34)}, s)'}; return {i}; }}", y, split) for i, (y, split) in enumerate((y, split) for split, n in (("train", 8), ("val", 2), ("test", 2)) for y in (1, 0) for _ in range(n // 2))]
    return spark.createDataFrame(rows, "code string, label int, split string")


def artifact_kind(steps: int | None, rows: int | None, tiny: int = 20) -> str:
    """`bootstrap` for a model of at most ``tiny`` training steps, or of as few rows where steps are unknown; `real` beyond; else `unknown`."""
    seen = steps if steps is not None else rows
    return "unknown" if seen is None else "bootstrap" if seen <= tiny else "real"


def declared_splits(df: DataFrame, split: str = "split") -> DataFrame:
    """``df`` with all_declared: whether every row has a split of its own (only then they are kept)."""
    whole = df.agg(F.coalesce(F.bool_and(F.col(split).isNotNull()), F.lit(False)).alias("all_declared"))
    return df.join(F.broadcast(whole))


def split_of_file(name: Column) -> Column:
    """train, val or test by what the file's name holds, in this order; else null."""
    n = F.lower(name)
    return F.when(n.contains("train"), "train").when(n.contains("val"), "val").when(n.contains("test"), "test")


def ratio_split(df: DataFrame, digest: Column, tie: tuple[str, ...], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """80/10/10 in the order of a hash: exact sizes, the same for the same rows."""
    ranked = hash_rank(df, digest, tie=tie)
    a, b = F.floor(F.col("total") * train), F.floor(F.col("total") * val)
    return ranked.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")).drop("rank", "total")


def guarded_val_split(df: DataFrame, digest: Column, tie: tuple[str, ...], fraction: float = 0.1) -> DataFrame:
    """train/val; val has a row at least if there are two, and train is never empty."""
    ranked = hash_rank(df, digest, tie=tie)
    n = F.col("total")
    size = F.when((n > 1) & F.lit(fraction > 0), F.least(n - 1, F.greatest(F.lit(1), F.floor(n * fraction)))).otherwise(0)
    return ranked.withColumn("split", F.when(F.col("rank") <= size, "val").otherwise("train")).drop("rank", "total")


def balanced(df: DataFrame, label: str, digest: Column, tie: tuple[str, ...], n: int) -> DataFrame:
    """n / 2 rows of label 1 and of label 0, the first by hash. Fails on an odd n or too few rows of a label."""
    if n % 2:
        raise ValueError("n must be even")
    ranked = hash_rank(df.where(F.col(label).isin(0, 1)), digest, by=(label,), tie=tie)
    short = F.when(F.col("total") < n // 2, F.raise_error(F.lit("too few rows of a label")).cast("boolean")).otherwise(True)
    return ranked.where((F.col("rank") <= n // 2) & short).drop("rank", "total")


def stratified(df: DataFrame, group: str, label: str, order: list[str], quotas: dict[int, int], cap: int, hard_first: list[str]) -> DataFrame:
    """Round robin: each lap takes a row of every (group, label), groups of ``hard_first`` first and then by name, label 1 before
    0; a label stops at its quota and a group at ``cap`` rows of both labels. Labels outside the quotas are left out.

    What a lap can take at all, at most ``cap`` rows a stratum, is cut out by window functions; the fold over these rows,
    whose number does not grow with the input but with groups * cap, is one task's.
    """
    place = Window.partitionBy(group, label).orderBy(*order)
    rows = df.where(F.col(label).isin(*quotas)).withColumn("lap", F.row_number().over(place)).where(F.col("lap") <= cap)
    hard = F.array(*map(F.lit, hard_first)).cast("array<string>")
    at = F.array_position(hard, F.col(group))
    rows = rows.withColumn("hardness", F.when(at > 0, at).otherwise(len(hard_first) + 1)).withColumn("one", F.lit(1))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lap", "hardness", group, label], ascending=[True, True, True, False], kind="stable")
        left, used, keep = dict(quotas), {}, []
        for g, y in zip(pdf[group], pdf[label], strict=True):
            take = left[y] > 0 and used.get(g, 0) < cap
            if take:
                left[y] -= 1
                used[g] = used.get(g, 0) + 1
            keep.append(take)
        return pdf[keep].drop(columns=["hardness", "one"])

    kept = [f for f in rows.schema if f.name not in ("hardness", "one")]
    from pyspark.sql.types import StructType

    return rows.groupBy("one").applyInPandas(fold, StructType(kept))


def budget_pick(df: DataFrame, digest: Column, tie: list[str], size: str, pair: str, label: str, max_rows: int, max_bytes: int, max_share: float = 0.62, reach: int = 8) -> DataFrame:
    """Greedy within row and byte budgets, in the order of a hash: whole pairs first, then single rows as long as no label
    has more than ``max_share`` of what is picked. What does not fit is skipped and costs nothing, so a running sum will not
    do. Units come in blocks of ``reach * max_rows``, in order, each of those alone that can still be taken; as the first of a block always
    is, there are no more blocks than rows to pick, and the pick ends when nothing fits or nothing is left.
    """
    units = df.withColumn("digest", digest).groupBy(pair).agg(F.min("digest").alias("digest"), F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max(label).alias("top"), F.min(pair).alias("unit"))
    units = units.where((F.col("bytes") <= max_bytes) & F.col("unit").isNotNull()).select("digest", "bytes", "n", "top", "unit").persist()
    kinds = dict(units.dtypes)
    rows = used = 0
    counts: dict = {}
    keep: list = []

    def barred() -> set:
        return {y for y, c in counts.items() if (c + 1) / (rows + 1) > max_share} if rows else set()

    for single in (False, True):
        left, at = units.where("n = 1" if single else "n > 1"), None
        while rows < max_rows:
            block = left.where((F.col("n") <= max_rows - rows) & (F.col("bytes") <= max_bytes - used))
            if at is not None:
                block = block.where(F.struct("digest", "unit") > F.struct(*[F.lit(at[c]).cast(kinds[c]).alias(c) for c in ("digest", "unit")]))
            out = barred() if single else set()
            for y in out:
                block = block.where(~F.col("top").eqNullSafe(F.lit(y)))
            found = block.orderBy("digest", "unit").limit(reach * max_rows).collect()
            for u in found:
                at = u
                if rows + u.n > max_rows or used + u.bytes > max_bytes or single and u.top in barred():
                    continue
                rows, used = rows + u.n, used + u.bytes
                for y in (u.top,) if single else (1, 0):
                    counts[y] = counts.get(y, 0) + 1
                keep.append((u.unit,))
                if single and out - barred():  # a label that was left out of the block may come again from here on
                    break
            else:
                if len(found) < reach * max_rows:
                    break
    units.unpersist()
    picked = F.broadcast(df.sparkSession.createDataFrame(keep, f"unit {kinds['unit']}"))
    return df.join(picked, df[pair] == picked["unit"], "left_semi")


def adjacent_pairs(df: DataFrame, position: str, key: str, label: str) -> DataFrame:
    """Rows at positions 2k and 2k+1: pair, key, and whether they are well formed (one key, labels 1 and then 0). An odd last row is left out."""
    rows = df.withColumn("pair", F.floor(F.col(position) / 2)).withColumn("side", F.col(position) % 2)
    out = rows.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("side") == 0, F.col(key))).alias("key"),
        F.max(F.when(F.col("side") == 1, F.col(key))).alias("key_after"),
        F.max(F.when(F.col("side") == 0, F.col(label))).alias("before"),
        F.max(F.when(F.col("side") == 1, F.col(label))).alias("after"),
    )
    good = F.col("key").eqNullSafe(F.col("key_after")) & F.coalesce((F.col("before") == 1) & (F.col("after") == 0), F.lit(False))
    return out.where("n = 2").select("pair", "key", good.alias("well_formed"))


def twin_rows(df: DataFrame, before: str, after: str, label: Column) -> DataFrame:
    """One row for the code before a fix, and for label 1 one for the code after it, if that is not blank and differs."""
    twins = F.array(F.struct(F.col(before).alias("code"), label.alias("label")), F.when((label == 1) & (F.trim(F.coalesce(after, F.lit(""))) != "") & ~F.col(before).eqNullSafe(F.col(after)), F.struct(F.col(after).alias("code"), F.lit(0).alias("label"))))
    return df.select("*", F.explode(F.filter(twins, lambda x: x.isNotNull())).alias("twin")).select(*df.columns, "twin.code", "twin.label")


def provenance(df: DataFrame, text: str, label: str, group: str) -> DataFrame:
    """One row: rows, rows by label, distinct groups, bytes, and the longest text."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)), F.lit(0)).alias("n_neg"),
        F.count_distinct(group).alias("n_groups"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.max(F.length(text)), F.lit(0)).cast("long").alias("longest"),
    )


def provenance_record(rows: DataFrame, text: str, label: str, group: str, files: DataFrame, caps: dict[str, int], leaks: DataFrame | None = None, **facts: str) -> DataFrame:
    """One row that says what a dataset is: ``facts`` (dataset, revision, license and so on), the counts of ``provenance``, rows by group, the caps that it was made
    under, how many rows a leakage check dropped (``leaks``, one row), and path, sha256 and rows of its files."""
    one = provenance(rows, text, label, group)
    groups = rows.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(group).cast("string"), "count")))).alias("per_group"))
    written = files.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "rows"))).alias("files"))
    out = one.crossJoin(groups).crossJoin(written)  # one row each
    if leaks is not None:
        out = out.crossJoin(leaks)
    limits = F.struct(*[F.lit(v).alias(k) for k, v in caps.items()]) if caps else F.lit(None).cast("string")
    return out.select(*[F.lit(v).alias(k) for k, v in facts.items()], "*", limits.alias("caps"))


def guard_rows(df: DataFrame, least: int) -> DataFrame:
    """``df``, or a failure when it has fewer rows: checked when it is read, before anything is written."""
    n = df.agg((F.count(F.lit(1)) >= least).alias("enough"))
    n = n.select(F.when(F.col("enough"), True).otherwise(F.raise_error(F.lit(f"fewer than {least} rows")).cast("boolean")).alias("_enough"))
    return df.join(F.broadcast(n)).where("_enough").drop("_enough")
