from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievework.llm import staging


class Session:
    """A session on a cluster without a folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        staging.shared_root(Session())


def test_staged_tables_go_between_marks(spark):
    before = staging.mark()
    one = staging.stage(spark.range(10), "one")
    two = staging.stage_by_key(spark.range(100).withColumnRenamed("id", "row"), "row", "two")
    assert one.count() == 10 and two.join(spark.range(5).withColumnRenamed("id", "row"), "row").count() == 5
    plan = two.join(spark.range(50).withColumnRenamed("id", "row"), "row")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    left = staging.mark()
    three = staging.stage(spark.range(3), "three")
    staging.release(before, left)
    assert three.count() == 3 and staging.mark() == before + 1
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        one.count()
    staging.release(before)


def test_batches_and_row_groups_are_bounded(spark):
    before = staging.mark()
    kept = spark.conf.get(staging.BATCH)
    rows = spark.range(0, 60, 1, 1).selectExpr("id", "concat_ws(' ', transform(sequence(1, 10000), x -> hash(x, id))) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    got = staging.stage(rows.mapInArrow(sizes, "rows long"), "sizes", 1 << 20)
    assert sum(r.rows for r in got.collect()) == 60 and max(r.rows for r in got.collect()) <= 12
    assert spark.conf.get(staging.BATCH) == kept
    staging.stage(rows, "groups", parquet_block_size=1 << 20, parquet_page_size_row_check_min=1)
    (file,) = Path(staging._written[-1][1].removeprefix("file://")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 20
    staging.release(before)
