import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import urls
from gridloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS", 2)  # many false positives, so many levels
    monkeypatch.setattr(urls, "HASHES", 2)
    rnd = random.Random(3)
    universe = [f"h{k}.example" for k in range(3000)]
    listed = set(rnd.sample(universe, 400)) | {"not.in.the.universe"}
    u, m = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in (universe, sorted(listed)))
    levels = urls.build_cascade(u, m)
    assert len(levels) > 3
    got = {r.key for r in u.where(urls.in_cascade(F.col("key"), levels)).collect()}
    assert got == listed & set(universe)


def test_a_long_blocklist_from_a_file(spark, tmp_path):
    """60,000 listed of 200,000 keys with the parameters of production: several levels, each once in the plan."""
    universe = spark.range(200_000).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("key"))
    (tmp_path / "list.txt").write_text("# blocked\n\n" + "\n".join(f" h{3 * k}.example" for k in range(60_000)), encoding="utf-8")
    listed = urls.read_blocklist(spark, str(tmp_path / "list.txt"))
    levels = urls.build_cascade(universe, listed)
    assert len(levels) >= 3 and levels[0].words * 64 >= 60_000 * urls.BITS
    got = universe.withColumn("listed", urls.in_cascade(F.col("key"), levels))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == len(levels)
    wrong = got.withColumn("n", F.regexp_extract("key", r"\d+", 0).cast("long")).where("listed != (n % 3 = 0 and n < 180000)")
    assert wrong.count() == 0 and got.where("listed").count() == 60_000


def test_a_level_above_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_LEVEL_BYTES", 8)
    keys = spark.range(100).selectExpr("cast(id as string) as key")
    with pytest.raises(ValueError, match="the bound is 8"):
        urls.build_cascade(keys, keys)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    got = sorted(map(str, (tuple(r) for r in QUERIES["op9_urls"](spark, sf_dir).collect())))
    assert got == sorted(map(str, con.execute(ORACLE_SQL["op9_urls"]).fetchall()))


def test_edge_cases(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://b.net/x", "b.net", "/x", "net/", "block"),
        (3, "https://b.net", "b.net", "", None, "allow"),
        (4, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (5, "x://example.com/de/q", "example.com", "/de/q", "example.com/de/", "block"),
        (6, "//no.scheme/x", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "", "", "", None, "allow"),
        (9, "ftp://Bad.Site?x", "bad.site", "", None, "block"),
        (10, "ftp://deep.bad.site#/fr/", "deep.bad.site", "", None, "block"),
        (11, "a://q.org/fr/://z", "q.org", "/fr/://z", "org/fr/", "allow"),
        (None, "a\nb://É.org/\nx", "É.org", "/\nx", None, "allow"),
        (12, "http://bad.site./" + "x" * 100_000, "bad.site.", "/" + "x" * 100_000, None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows] + [(1, rows[0][1])], "page_id long, url string").selectExpr("*", "1 as host", "2 as id", "3 as key")
    listed = spark.createDataFrame([("BAD.site",), (None,)], "key string")
    got = [tuple(r) for r in urls.filter_urls(df, listed, URL_RULES).collect()]
    want = [(r[0], *r[2:]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, [*want, want[0]]))
    assert urls.filter_urls(df.limit(0), listed, URL_RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, listed.limit(0), []).collect()} == {"allow"}
