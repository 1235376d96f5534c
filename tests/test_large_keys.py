"""Queries over keys that only larger tables have."""

import random

import numpy as np
from pyspark.sql import functions as F

from terrasift.operators import rings
from terrasift.plans import catalogue


def test_pending_page_of_five_digits(spark, tmp_path):
    spark.createDataFrame([(9999, 7), (1200000, 8)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["doc_id"], r["table_no"]): r["printed_page"] for r in catalogue.q_index_parse(spark, str(tmp_path)).collect()}
    assert got == {(9999, "7"): 9999, (9999, "99"): 10000, (1200000, "8"): 1200000, (1200000, "99"): 1200001}


def test_easting_of_the_last_whole_metre(spark, tmp_path):
    spark.createDataFrame([(899999, 5), (900000, 6)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: (r["numbers"], r["easting"]) for r in catalogue.q_num_tokens(spark, str(tmp_path)).collect()}
    assert got == {899999: (4, 999999.5), 900000: (4, 100000.5)}


def test_rings_go_to_python_as_flat_numbers(spark):
    """Vertices are no objects there (a dict each took most of a worker's memory); a place that is missing is NaN."""
    vertex = "struct<name:string,y:double,x:double>"
    df = spark.createDataFrame([(7, [("a", 1.0, 2.0), ("b", None, 4.0)]), (8, [])], f"ring long, points array<{vertex}>")
    sizes = lambda r: (len(r), float(np.nansum(r)), str(r.dtype))
    out = rings.by_ring(df, "n long, total double, kind string", sizes)
    assert sorted(map(tuple, out.collect())) == [(7, 2, 7.0, "float64"), (8, 0, 0.0, "float64")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_rotations_of_long_rings(spark):
    """As all rotations of both directions, with equal and missing tokens; long rings do not make all of them."""
    rng = random.Random(9)
    pool = ["a", "b", "c", "aa", None]
    given = [[rng.choice(pool[: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 8))] for _ in range(300)]
    long = [str(rng.randrange(1000000)) for _ in range(20000)]
    df = spark.createDataFrame(list(enumerate([*given, long, long[9000:] + long[:9000], long[::-1]])), "i int, t array<string>")
    got = [r["c"] for r in df.select("i", rings.canonical(F.col("t")).alias("c")).orderBy("i").collect()]

    def plain(t):
        r = t[:-1] if len(t) > 1 and t[0] is not None and t[0] == t[-1] else t
        key = lambda z: [(x is not None, x or "") for x in z]
        return min((z[k:] + z[:k] for z in (r, r[::-1]) for k in range(len(z))), key=key, default=[])

    assert got[:300] == [plain(t) for t in given]
    assert got[300] == got[301] == got[302] and got[300][0] == min(long)
