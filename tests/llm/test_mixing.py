"""Mixing against the plain definition and its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasift.llm import mixing


def rows(n=400):
    out = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 40)), f"s{i % 5 if i % 3 else 0}", i) for i in range(n)]
    return out + [(None, "a b c", "s1", 1), (n + 1, None, "s1", 1), (n + 2, "x y", None, 1), (n + 3, "", "empty", 0)]


def test_against_sql(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(key(r) for r in con.execute(mixing.ORACLE).fetchall())
    for bucket in (5_000, 7):
        mixing.BUCKET = bucket
        got = sorted(key(r) for r in mixing.mixed(df).collect())
        assert got == want
    mixing.BUCKET = 5_000


def test_targets_and_repeats(spark):
    base = [(i, "a " * (1 + i % 9), "big" if i % 3 else "small") for i in range(90)]
    df = spark.createDataFrame(base + base[:30] + base[:30], "doc_id long, text string, source string")
    out = mixing.mix(*mixing.measured(df, "doc_id", "source")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    for r in out:
        assert abs(r["taken"] - r["target"]) <= 4 and not r["over"]


def test_caps_are_reshared(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["a"] == 3 and got["b"] + got[None] == pytest.approx(1998) and got["b"] == pytest.approx(2 * got[None])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).collect() == []
    zero = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mixed(zero).collect()] == [(1, 0, 0, 0.0, 0)]


def test_names_of_the_caller_may_clash(spark):
    """Columns that only look like the operator's own pass through; those it makes are replaced."""
    rows_ = [(1, "a b c", "s", 7, "w", "l", 9, "key", 3), (2, "a " * 9, "t", 8, "w", "l", 9, "key", 3)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, _size int, _words string, _level string, Size int, _key string, taken int")
    out, size, level = mixing.measured(df, *df.columns)
    got = {r["doc_id"]: r for r in mixing.mix(out, size, level).drop(size, level).collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "source", "_size", "_words", "_level", "_key", "size", "source_size", "target", "taken"}
    assert [(got[i]["_size"], got[i]["_words"], got[i]["_level"], got[i]["_key"], got[i]["size"]) for i in (1, 2)] == [(7, "w", "l", "key", 3), (8, "w", "l", "key", 9)]
