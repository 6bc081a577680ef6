"""Classification metrics as aggregates: confusion counts, sweeps, AUC, thresholds, class weights, quality gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.ranks import running_sums


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy of tp, fp, fn and tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return df.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def confusion(score: Column, label: Column, threshold: Column) -> list[Column]:
    cell = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    hit = score >= threshold
    return [cell(hit & (label == 1), "tp"), cell(hit & (label == 0), "fp"), cell(~hit & (label == 1), "fn"), cell(~hit & (label == 0), "tn")]


def metrics_at(df: DataFrame, threshold: float, by: Column | None = None) -> DataFrame:
    """At one threshold (inclusive), over all rows or by group; a missing group is '?'."""
    cells = confusion(F.col("score"), F.col("label"), F.lit(threshold))
    if by is None:
        return rates(df.agg(*cells))
    grouped = df.groupBy(F.coalesce(by.cast("string"), F.lit("?")).alias("grp"))
    return rates(grouped.agg(F.count(F.lit(1)).alias("n"), *cells))


def sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """At several thresholds in one pass: rows are counted by the number of thresholds they reach, and these few counts summed."""
    steps = sorted(thresholds)
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in steps), F.lit(0))
    counts = df.groupBy(reached.alias("reached")).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"))
    table = counts.select("*", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])).alias("s"))
    hit = F.col("reached") >= F.col("s.i")
    cell = lambda c, v, name: F.sum(F.when(c, F.col(v)).otherwise(0)).cast("long").alias(name)
    return rates(table.groupBy("s.threshold").agg(cell(hit, "pos", "tp"), cell(hit, "neg", "fp"), cell(~hit, "pos", "fn"), cell(~hit, "neg", "tn")))


def best_f1(df: DataFrame) -> DataFrame:
    """Of the thresholds 0.01 to 0.99 the one with the best F1, the lowest of equals."""
    table = sweep(df, [i / 100 for i in range(1, 100)])
    return table.agg(F.max_by(F.struct("threshold", "f1", "tp", "fp", "fn", "tn"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def areas(df: DataFrame, buckets: int = 1000) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null unless both labels occur. Scores lie in [0, 1].

    Rows are first counted by score; sums over greater scores are then taken by bucket and inside buckets.
    """
    steps = df.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"))
    steps = running_sums(steps, F.col("score"), F.floor(F.col("score") * buckets), {"pos_above": "pos", "neg_above": "neg"})
    pos, above, neg, neg_above = (F.col(c).cast("double") for c in ("pos", "pos_above", "neg", "neg_above"))
    out = steps.agg(
        F.sum(neg * above + neg * pos * F.lit(0.5)).alias("wins"),
        F.sum(pos * (pos + above) / (pos + above + neg + neg_above)).alias("steps"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(F.when(both, F.col("wins") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("steps") / F.col("p")).alias("pr_auc"))


def class_weights(df: DataFrame) -> DataFrame:
    """total / (2 n) by label; null when a label does not occur."""
    out = df.agg(F.coalesce(F.sum(F.when(F.col("label") == 0, 1)), F.lit(0)).cast("double").alias("n0"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0)).cast("double").alias("n1"))
    total, both = F.col("n0") + F.col("n1"), (F.col("n0") > 0) & (F.col("n1") > 0)
    return out.select(F.when(both, total / (2 * F.col("n0"))).alias("w0"), F.when(both, total / (2 * F.col("n1"))).alias("w1"))


def quality_gate(spark: SparkSession, metrics: DataFrame, floors: dict[str, float | None]) -> DataFrame:
    """Of one row of metrics the floors that fail: a missing metric or one below its floor. A floor of None is no floor."""
    wanted = [(k, float(v)) for k, v in floors.items() if v is not None]
    table = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(v).alias("floor"), (F.col(k).cast("double") if k in metrics.columns else F.lit(None).cast("double")).alias("value")) for k, v in wanted])
    return metrics.select(F.explode(table).alias("g")).select("g.*").where("value is null or value < floor")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.lower(F.col(column)), F.lit("")), F.lit("?")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def score_texts(text: Column, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 256) -> Column:
    """Scores by any scorer. ``load`` is called once a task and returns what scores a list of at most ``batch`` texts; null has no score."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = load()
        for column in columns:
            out: list[float | None] = []
            for at in range(0, len(column), batch):
                texts = column.slice(at, batch).to_pylist()
                scores = iter(scorer([t for t in texts if t is not None]))
                out += [None if t is None else float(next(scores)) for t in texts]
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, T.DoubleType())(text)


def map_in_order(df: DataFrame, seq: str, value: str, make: Callable[[], Callable[[str], str]], fallback: Callable[[str], str]) -> DataFrame:
    """``df`` sorted by ``seq``, with result and failed: what a function that may fail makes of each value, in parallel; one that fails gets the fallback's
    result and the run goes on."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for column in columns:
            rows = []
            for v in column.to_pylist():
                try:
                    rows.append((one(v), False))
                except Exception:  # of any kind: the value's own result is the fallback
                    rows.append((fallback(v), True))
            yield pa.StructArray.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.bool_())], ["result", "failed"])

    kind = T.StructType([T.StructField("result", T.StringType()), T.StructField("failed", T.BooleanType())])
    out = df.withColumn("_made", F.arrow_udf(run, kind).asNondeterministic()(F.col(value)))
    return out.select(*df.columns, "_made.*").orderBy(seq)
