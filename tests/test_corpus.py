"""Allocation, distributions, projection, jobs: fixtures and the stream against the replay."""

import random

from pyspark.sql import functions as F

from terrasift.operators import corpus, index, rings
from terrasift.streaming import jobs


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("z", 0)], "key string, population long")
    got = {r["key"]: r["quota"] for r in corpus.largest_remainder(df, 7, minimum_one=True).collect()}
    assert got == {"a": 3, "b": 2, "c": 2, "z": 0}


def test_nearest_allocation_sums_up(spark):
    rng = random.Random(1)
    for total in (7, 20, 33):
        rows = [(f"k{i}", rng.randrange(0, 40)) for i in range(9)]
        df = spark.createDataFrame(rows, "key string, population long")
        got = corpus.nearest_allocation(df, total).collect()
        assert sum(r["quota"] for r in got) == total and all(0 <= r["quota"] <= r["population"] for r in got)


def test_distribution(spark):
    df = spark.createDataFrame([("x", i) for i in range(1, 11)], "k string, v long")
    (r,) = corpus.distribution(df, ["k"], "v").collect()
    assert (r["total"], r["mean"], r["median"], r["p90"], r["maximum"]) == (55, 5.5, 5.5, 9, 10)


def test_projection(spark):
    population = spark.createDataFrame([("F", "EK-1")] * 40 + [("F", "EK-2")] * 10, "a string, b string")
    sample = spark.createDataFrame([("F", "EK-1", x) for x in (True, True, True, False)], "a string, b string, quick boolean")
    got = {r["b"]: (r["estimate"], r["covered"]) for r in corpus.projection(population, sample, ["a", "b"], F.col("quick")).collect()}
    assert got == {"EK-1": (30.0, True), "EK-2": (None, False)}


def test_canonical_ring(spark):
    base = list("abcd")
    same = [base, base[::-1], base[2:] + base[:2], [*base, "a"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*same, list("acbd"), []])], "i int, t array<string>")
    got = [tuple(r["c"]) for r in df.select("i", rings.canonical(F.col("t")).alias("c")).orderBy("i").collect()]
    assert len(set(got[:4])) == 1 and got[4] != got[0] and got[5] == ()


def test_index_with_pending_page(spark):
    lines = ["TABLOLAR DİZİNİ", "Tablo 1. Ruhsat Alanı ........ 12", "Tablo 2,3 ÇED Alanı Koordinatları", "45", "KAYNAKÇA", "Tablo 9. Başka 3"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line_no int, text string")
    got = [(r["table_no"], r["title"], r["printed_page"], r["in_index"]) for r in index.entries(df).orderBy("line_no").collect()]
    assert got == [("1", "Ruhsat Alanı", 12, True), ("2.3", "ÇED Alanı Koordinatları", 45, True), ("9", "Başka", 3, False)]


def test_transitions():
    assert jobs.advance(None, 0, "PENDING") == ("PENDING", 0, True)
    assert jobs.advance("PENDING", 0, "IN_PROGRESS") == ("IN_PROGRESS", 1, True)
    assert jobs.advance("COMPLETED", 1, "PENDING") == ("COMPLETED", 1, False)


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"j{i % 5}", i, rng.choice(list(jobs.TRANSITIONS))) for i in range(120)]
    schema = "job_id string, seq long, wanted string"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream(stream).writeStream.format("memory").queryName("jobstates").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: tuple(r)
    last = {}
    for r in spark.sql("select * from jobstates").collect():
        if r["job_id"] not in last or r["accepted"] + r["rejected"] > last[r["job_id"]]["accepted"] + last[r["job_id"]]["rejected"]:
            last[r["job_id"]] = r
    # Files may be taken in any order; each job's events are counted once in either run.
    replayed = {r["job_id"]: r for r in jobs.replay(spark.createDataFrame(rows, schema)).collect()}
    assert {j: r["accepted"] + r["rejected"] for j, r in last.items()} == {j: r["accepted"] + r["rejected"] for j, r in replayed.items()}
    assert all(key(r) for r in last.values())


def test_enqueue(spark):
    rows = [("a", 1, 1, "OK", "USEFUL_PARTIAL", False, True, 1), ("a", 1, 1, "OK", "USEFUL_PARTIAL", False, True, 2), ("b", 1, 1, "HATA", None, None, None, 3), ("c", 1, 1, "OK", "COMPLETE", False, True, 4)]
    df = spark.createDataFrame(rows, "path string, size long, mtime long, status string, completeness string, fallback_used boolean, deferred boolean, created_at long")
    assert {(r["created_at"], r["reason"]) for r in jobs.enqueued(df).collect()} == {(1, None), (2, "DUPLICATE"), (3, "PRIMARY_FAILED"), (4, "ALREADY_COMPLETE")}
