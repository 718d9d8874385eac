import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import registry, urlfilter


def test_keys_of_urls(spark):
    urls = ["HTTPS://User@A.b.Example.com:80/x//Y/?q#f", "http://example.com", "nothing", "http:///p", "http://localhost/a", "ftp://h.co./z", None, "", "http://[::1]:80/a", "http://10.1.2.3:8/b", "http://10.1.2.3.org"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(urlfilter.keys(F.col("u")).alias("k")).collect()]
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/Y"]
    assert got[1] == ["example.com"]
    assert got[2] == [] and got[3] == [] and got[7] == [] and not got[6]
    assert got[4] == ["localhost", "localhost/a"]
    assert got[5] == ["h.co", "h.co/z"]
    assert got[8] == ["[::1]", "[::1]/a"] and got[9] == ["10.1.2.3", "10.1.2.3/b"]
    assert got[10] == ["10.1.2.3.org", "1.2.3.org", "2.3.org", "3.org"]


@pytest.mark.parametrize("bucket", [None, 4, 0.5])
def test_same_as_replaying_the_lists(spark, bucket):
    random.seed(2)
    names = ["a.com", "b.a.com", "c.org", "b.a.com/p", "b.a.com/p/q", "hot.net"]
    entries = [(random.choice(names), random.choice([None, *range(20)]), random.choice([True, False, None])) for _ in range(80)] + [(None, 1, True), ("HOT.net", 3, True)]
    captures = [(k, random.choice(["http://b.a.com/p/q/r", "https://a.com/", "http://x.c.org/p?b.a.com", "http://hot.net/1", "junk", None]), random.choice([None, *range(-1, 22)])) for k in range(300)]
    captures += captures[:5]
    got = urlfilter.evaluate(
        spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, fetched long, key string"),
        spark.createDataFrame([(*e, "x") for e in entries], "key string, at long, listed boolean, url string"),
        columns=("page_id",),
        bucket=bucket,
    ).collect()
    by_url = {r.url: r.k for r in spark.createDataFrame([(c[1],) for c in captures if c[1]], "url string").select("url", urlfilter.keys(F.col("url")).alias("k")).collect()}

    def active(key, at):
        past = [(t, listed) for k, t, listed in entries if k and k.lower() == key.lower() and None not in (t, listed) and t <= at]
        last = max((t for t, _ in past), default=None)
        return last if any(listed for t, listed in past if t == last) else None

    want = []
    for i, url, at in captures:
        hits = sorted((k.lower(), active(k, at)) for k in by_url.get(url, []) if at is not None and active(k, at) is not None)
        want.append((i, url, at, bool(hits), *(hits[0] if hits else (None, None))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_query_and_its_sql(spark, tmp_path):
    rows = [(k, u) for k, u in enumerate(["http://[::1]:80/a/b", "http://10.1.2.3/x", "https://u.of.example.org/a", None, "junk"] * 40)]
    spark.createDataFrame([(k, u and u.replace("x", f"x{k % 9}").replace("of", f"of{k % 7}")) for k, u in rows], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["op10_urls"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = connection.sql(f"SELECT page_id, url, fetched, blocked, matched, since FROM ({urlfilter.ORACLE_SQL})").fetchall()
    assert any(r.blocked for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com", 3)], "page_id long, url string, fetched long")
    entries = spark.createDataFrame([], "key string, at long, listed boolean")
    assert [r.blocked for r in urlfilter.evaluate(captures, entries).collect()] == [False]
    assert urlfilter.evaluate(captures.limit(0), entries).count() == 0
