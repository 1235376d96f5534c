"""Each stage of the pipeline on its own input, with clashing columns and odd rows."""

import re
import zlib
from collections import Counter

import pytest
from plain_linear import plain_model
from pyspark.sql import functions as F

from terrasift.llm import decontaminate, linear, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def sf_dir(spark, tmp_path):
    good = ["the house by the river was green and quiet in the early morning light of may", "many people walk along the market street with baskets full of bread and fruit", "she wrote a long letter to her brother about the garden and the old stone wall"]
    docs, labels = [], []
    for i in range(120):
        text = f"{good[i % 3]} number {i} " + " ".join(f"w{i}x{j}" for j in range(40)) if i % 4 else "BUY!! NOW!! $$$ " * 20 + str(i)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 4 > 0), 0))
    docs += [(500, docs[1][1], "en", "s0", 1), (501, docs[2][1] + " mail a.b@c.de", "en", "s1", 1)]
    edited = docs[6][1].split()
    edited[20] = "changed"
    docs += [(505, " ".join(edited), "en", "s2", 1), (501, docs[7][1] + " and more", "en", "s1", 1), (None, docs[9][1], "en", "s0", 1), (None, "a text of its own " + docs[10][1][::-1], "en", "s0", 1)]
    docs += [(502, " ".join(f"b{j}" for j in range(30)) + " " + docs[5][1], "en", None, 1), (503, None, None, None, None), (504, "", "en", "s0", 0)]
    bench = [(1, " ".join(f"b{j}" for j in range(30)))]
    clash = [(*r, 1.0, "r", 2, "s") for r in docs]
    spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _size int, `root` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        rows = {r["doc_id"]: r for r in docs.collect()}
        kept.append(rows)
        if k < 4:
            assert docs.columns == columns, name
    quality, near, clean, private, mixed = kept
    assert 505 in quality and 505 not in near and 6 in near
    assert not {i for i in quality if i is not None and i < 120 and i % 4 == 0} and {1, 2, 500, 502} <= set(quality)
    assert 500 not in near and 1 in near and 502 in near
    assert 502 not in clean and set(near) - set(clean) == {502}
    assert all("a.b@c.de" not in (r["text"] or "") for r in private.values()) and set(private) == set(clean)
    assert set(mixed) <= set(private) and all(r["taken"] > 0 for r in mixed.values())


def jaccard_classes(rows):
    """A row's class number by comparing all pairs of five-word shingle sets."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def plain_run(spark, sf_dir):
    """(doc_id, text, taken) by plain loops, and the mix in one SQL statement."""
    import duckdb
    import pandas as pd

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    sample = linear.labelled_sample(docs, labels, "quality").orderBy("h", "y", F.xxhash64("t"), "t").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in labels.collect())
    model = plain_model([(bytes(r["t"]), r["y"]) for r in sample], linear.Quality(), linear.QUALITY)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if model((r["text"] or "").encode()) >= 0.7]
    first = {}
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    classes = jaccard_classes(rows)
    for r, c in zip(rows, classes, strict=True):
        if c not in first or order(r) < order(first[c]):
            first[c] = r
    rows = list(first.values())
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = lambda t: (t or "").encode().lower().translate(None, decontaminate.PUNCTUATION).split()
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4)))
    near = lambda w, t: any(decontaminate.weighted_jaccard(grams(w[s : s + len(t)]), grams(t)) >= 0.8 for s in range(max(1, len(w) - len(t) + 1)))
    rows = [r for r in rows if not any(near(words(r["text"]), words(t)) for t in items)]
    for r in rows:
        if r["text"] is not None:
            r["text"] = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", r["text"])
    documents = pd.DataFrame([{k: r[k] for k in ("doc_id", "text", "source")} for r in rows]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    taken = con.execute(mixing.ORACLE).fetchall()
    return sorted(((i, size, t) for i, size, _, _, t in taken if t > 0), key=str)


def test_run_equals_brute_force_and_itself(spark, sf_dir):
    pick = lambda df: sorted(((r["doc_id"], r["size"], r["taken"]) for r in df.collect()), key=str)
    got = pick(corpus_pipeline.run(spark, sf_dir))
    assert got == plain_run(spark, sf_dir) and len(got) > 30
    assert got == pick(corpus_pipeline.run(spark, sf_dir))


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
