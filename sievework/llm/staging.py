"""Shared-folder staging: cuts lineage without any copy that lives on one executor only."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str, str | None]] = []
#: Shuffle files of a query go when it ends and not whenever the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What is handed to Python at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset a temporary one is set, but only for a session in one
    process: executors of a cluster would write to disks of their own, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        root = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def _tidy(spark: SparkSession, batch: int | None = None):
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/sievework/{uuid.uuid4().hex}-{name}"


def stage(df: DataFrame, name: str, batch: int | None = None, **options: int) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Every executor can read the files, so a lost executor costs a re-read and not a recomputation.
    The folder goes when the Python driver ends, or with ``release``. ``batch``: bytes that Python gets at once, one row at
    least; ``options`` go to the writer, with dots for underscores.
    """
    spark = df.sparkSession
    path = _place(spark, name)
    schema = df.schema
    with _tidy(spark, batch):
        df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).option("compression", "zstd").parquet(path)
    _written.append((spark, path, None))
    return spark.read.schema(schema).parquet(path)


def stage_by_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stage``, dealt by ``key`` into as many buckets as there are shuffle partitions: joins on ``key`` move only their
    other side."""
    spark = df.sparkSession
    path, table = _place(spark, name), f"sievework_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    with _tidy(spark):
        df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    _written.append((spark, path, table))
    return spark.table(table)


def mark() -> int:
    """How much is staged so far, for ``release``."""
    return len(_written)


def release(since: int, until: int | None = None) -> None:
    """Delete what was staged between two marks; results that are not yet stored elsewhere are lost with it."""
    gone = _written[since:until]
    del _written[since:until]
    for spark, path, table in gone:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already
            return


def drop_staged() -> None:
    """Delete all that was staged."""
    release(0)


atexit.register(drop_staged)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; any others, whatever they are called, are left out."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
