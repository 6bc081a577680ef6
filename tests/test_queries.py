"""Every registered query against its SQL, on the smallest driver tables."""

import datetime

import duckdb
import pytest

from sievework import catalogue

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, database, name):
    df = catalogue.QUERIES[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        return
    want = database.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


def test_the_rest_works_without_what_the_optional_package_needs():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalogue.__file__).parents[1]
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'primary_rule' in q and 'op1_langid' not in q and 'pipeline' not in q and 'op4_license' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_no_other_module_needs_the_optional_package():
    import re
    from pathlib import Path

    root = Path(catalogue.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", f.read_text(), re.M), f
