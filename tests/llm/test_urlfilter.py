import datetime as dt
import random
from urllib.parse import urlsplit

import duckdb
import pytest

from sievework.llm import urlfilter
from sievework.llm.queries import ORACLES, op6_urlfilter

DAY = dt.datetime(2024, 1, 1)


def brute_force(captures, entries):
    state = {}
    for name, kind, pattern, action, listed in sorted({e for e in entries if None not in e}, key=lambda e: (e[4], e[3])):
        state.setdefault((name, kind, pattern.lower()), []).append((listed, action))
    out = []
    for i, url, at in captures:
        active = []
        parts = urlsplit(url or "")
        host = (parts.netloc.rsplit("@", 1)[-1].split(":")[0]).lower() if "://" in (url or "") else ""
        path = "/".join([host, *[s for s in parts.path.split("/") if s]]) + "/"
        for (name, kind, pattern), changes in state.items():
            if not host or at is None:
                continue
            hit = {"host": host == pattern, "domain": host == pattern or host.endswith("." + pattern), "prefix": path.startswith(pattern + "/")}[kind]
            now = [a for t, a in changes if t <= at]
            if hit and now and now[-1] == "add":
                active.append(name)
        out.append((i, url, at, bool(active), len(active), ",".join(sorted(set(active)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlfilter, "BROADCAST_ENTRIES", broadcast)
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "c.org", "ba.com"]
    entries = []
    for _ in range(60):
        kind = rng.choice(["host", "domain", "prefix"])
        pattern = rng.choice(hosts) + (rng.choice(["/p", "/p/q", "/pq"]) if kind == "prefix" else "")
        entries.append((rng.choice("LM"), kind, rng.choice([pattern, pattern.upper()]) if kind != "prefix" else pattern, rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(days=rng.randrange(20))))
    entries += entries[:5] + [("L", None, "a.com", "add", DAY)]
    captures = [(i, rng.choice(["http://", "HTTPS://u@"]) + rng.choice(hosts) + rng.choice(["", ":80", ""]) + rng.choice(["", "/", "/p", "/p/q/", "/pq?p/q", "/p#x", "//p"]), DAY + dt.timedelta(days=rng.randrange(-2, 25), hours=rng.choice([0, 5]))) for i in range(200)]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http://a.com/", None), (903, "http://a.com/p", DAY), (903, "http://a.com/p", DAY), (None, "http://c.org", DAY), (904, "http://a.com/" + "p/" * 2000, DAY)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp").selectExpr("*", "1 as kind", "'z' as list")
    got = urlfilter.evaluate(df, spark.createDataFrame(entries, urlfilter.ENTRY_SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(captures, entries)


def test_empty_tables(spark):
    entries = spark.createDataFrame([], urlfilter.ENTRY_SCHEMA)
    captures = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id int, url string, fetched timestamp")
    assert not urlfilter.evaluate(captures, entries).first().blocked
    assert urlfilter.evaluate(captures.limit(0), urlfilter.listed_entries(spark)).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    got = sorted((tuple(r) for r in op6_urlfilter(spark, path).collect()), key=str)
    assert got == sorted(con.sql(ORACLES["op6_urlfilter"]).fetchall(), key=str)
