import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing
from gridloom.llm.queries import ORACLE_SQL, QUERIES
from gridloom.llm.shared import n_words


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing what is above a cap, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not above:
            return target | {s: unit * weight[s] for s in open_}
        for s in above:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
        open_ -= above
    return target


def rows_of(sizes):
    out, i = [], 0
    for s, total in sizes.items():
        while total > 0:
            n = min(total, 1 + i * 7 % 23)
            out.append((i, " ".join(["w"] * n), s))
            total, i = total - n, i + 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 50, "b": 1000, None: 10, "é": 300, "z": 5}, {"a": 7}, {"b": 100, "a": 100, "c": 100, "d": 1}])
def test_targets_and_cuts(spark, sizes):
    df = spark.createDataFrame(rows_of(sizes), "doc_id long, text string, source string")
    got = mixing.mix(df, n_words(F.col("text"))).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    want = fill(sizes)
    assert len(got) == df.count()
    for s, total in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {total} and all(abs(r.target - want[s]) < 1e-6 for r in own)
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert sum(r.taken % r.size > 0 for r in own) <= 1  # one row is cut at most


def test_any_number_of_ranges_gives_the_same(spark):
    df = spark.createDataFrame(rows_of({"a": 3000, "b": 900}), "doc_id long, text string, source string")
    take = lambda n: {r.doc_id: r.taken for r in mixing.mix(df, n_words(F.col("text")), ranges=n).select("row.doc_id", "taken").collect()}
    assert take(None) == take(1) == take(500)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op5_mix"](spark, sf_dir).collect())
    assert got == sorted(con.execute(ORACLE_SQL["op5_mix"]).fetchall())


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z", None), (4, "w " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as row", "3 as taken", "'k' as key")
    got = mixing.mix(df, n_words(F.col("text"))).collect()
    assert len(got) == len(rows) and all(r.row.size == 1 and r.row.taken == 3 for r in got)
    out = mixing.materialize(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert {k: v for k, v in words.items()} == {s: sum(r.taken for r in got if r.row.source == s) for s in words}
    empty = df.limit(0)
    assert mixing.mix(empty, n_words(F.col("text"))).count() == 0 and mixing.materialize(empty).count() == 0
    assert sum(r.taken for r in mixing.mix(df.where("doc_id = 2"), n_words(F.col("text"))).collect()) == 0
