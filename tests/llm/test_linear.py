"""Held-out accuracy, counterfactual pairing, edge cases."""

import random
import zlib
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from plain_linear import plain_model
from pyspark.sql import functions as F

from terrasift.llm import linear


def test_quality_held_out(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "reason", "house", "walks", "green"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$%", "click###"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i < 300] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in linear.quality_scores(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert sum((got[i] >= 0.7) == bool(y) for i, _, y in rows[300:]) >= 98


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in linear.quality_scores(docs, labels).collect()] == [0.5]
    assert linear.toxicity_scores(docs.where(F.lit(False)), labels).collect() == []


def test_pairing_reduces_the_effect_of_group_mentions():
    """Half of the toxic training texts mention one group; the penalty keeps neutral mentions low."""
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["morning", "market", "river", "music", "people"]) for _ in range(8))
    train = []
    for i in range(300):
        toxic = i % 3 == 0
        group = "muslim" if toxic and i % 2 else rng.choice(["christian", "hindu", "none"])
        train.append((f"{filler()} {group} {'idiot' if toxic else 'fine'} {filler()}".encode(), int(toxic)))
    score = lambda w, t: (lambda o, c: 1 / (1 + np.exp(-(w[c].sum() + w[-1]))))(*linear.Toxic()([t]))
    s = linear.Settings(1.0, 1.0, 0.5, 0.0, 4, 0.0)
    free, none = linear.fit(iter(train), linear.Toxic(), s)
    paired, pairs = linear.fit(iter(train), linear.Toxic(), linear.Settings(1.0, 1.0, 0.5, 0.0, 4, 2.0))
    assert none == 0 and pairs == sum(b" none " not in t for t, _ in train)
    gap = lambda w: abs(np.log(score(w, b"a muslim market") / (1 - score(w, b"a muslim market"))) - np.log(score(w, b"a hindu market") / (1 - score(w, b"a hindu market"))))
    assert gap(paired) < 0.5 * gap(free)
    assert score(paired, b"you idiot") > 0.5 > score(paired, b"a muslim market")


def test_swap():
    swaps = linear.Swaps()
    text = b"plain text"
    assert swaps.sentence(text, 1) is text and swaps.pair(text, 1) is None and linear.Swaps(()).pair(b"many women", 0) is None
    out = swaps.sentence(b"many Women, and gay people", 0).split()
    assert out[1] != b"Women," and out[3] != b"gay" and out[0] == b"many"
    own, other = swaps.pair(b"No term here. Here are women! And none.", 5)
    assert own == b" Here are women!" and other.split()[:2] == [b"Here", b"are"] and other != own


def test_derived_groups(spark):
    """Frequent words under both labels are grouped with their company; telling and rare words are not."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = rng.sample(["aa", "ab", "ac", "ad"] if i % 2 else ["xx", "xy", "xz"], 3) + [f"rare{i}"] + (["awful"] if i % 4 > 1 else [])
        rows.append((i, int(i % 4 > 1), bytearray(" ".join(words).encode())))
    df = spark.createDataFrame(rows, "h long, y int, t binary")
    assert sorted(map(sorted, linear.derived_groups(df))) == [["aa", "ab", "ac", "ad"], ["xx", "xy", "xz"]]
    assert linear.derived_groups(df.where("y = 0")) == [] and linear.derived_groups(df.limit(0)) == []


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_queries_equal_brute_force(spark, tmp_path, label, monkeypatch):
    """The registered queries: folds, labels, thresholds, and scores as of a plain model of the same rows."""
    from terrasift.llm import queries

    features, s = (linear.Quality(), linear.QUALITY) if label == "quality" else (linear.Toxic(), replace(linear.TOXIC, pairing=0.0))
    if label == "toxic":
        monkeypatch.setattr(linear, "TOXIC", s)
    rng = random.Random(2)
    word = lambda: rng.choice(["river", "stone", "Light,", "walk", "GREEN", "aaaa", "x1", "été"])
    rows = [(i, " ".join([word() for _ in range(rng.randrange(0, 25))] + (["bad", "awful!"] if i % 3 == 0 else [])), i % 3 == 0) for i in range(150)]
    rows += [(200, None, None), (201, "", True), (202, rows[0][1], True), (203, rows[0][1], False), (204, "stone " * 30_000, None)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(7, "repeated id", 1.0), (None, "no id", 1.0)], "doc_id long, text string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(y), int(y)) for i, _, y in rows if y is not None] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mod, out, threshold = (4, 2, 0.7) if label == "quality" else (5, 0, 0.5)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % mod == out
    got = getattr(queries, "op3_quality" if label == "quality" else "op4_toxicity")(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    sample = [(r["t"], r["y"]) for r in linear.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~F.col("doc_id").isin([i for i, *_ in rows if held(i)])), label).orderBy("h", "y", F.xxhash64("t"), "t").collect()]
    assert len(sample) == sum(not held(i) for i, _, y in rows if y is not None) + (not held(7))
    model = plain_model([(bytes(t), y) for t, y in sample], features, s)
    texts = Counter()
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1
        texts[r["doc_id"]] += 1
        if r["doc_id"] not in (7, None):
            text = next(t for i, t, _ in rows if i == r["doc_id"])
            assert abs(r["score"] - model((text or "").encode())) < 1e-4
    assert texts[7] == 2 and texts[None] == 1


def test_registered_toxicity_forms_pairs(spark):
    """On the generated tables, whose texts have none of the fixed terms, the derived groups give pairs."""
    sf_dir = Path("/root/testdata/sf0.001")
    if not sf_dir.exists():
        pytest.skip("no generated tables here")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert linear.learnt(docs, labels, "toxic", linear.Toxic(), linear.TOXIC).pairs > 0


def test_kept_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5, "x")], "doc_id long, text string, score double, bytes string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = linear.quality_scores(docs, labels, keep=("doc_id", "score", "bytes"), name="score_").collect()
    assert [(r["doc_id"], r["score"], r["bytes"]) for r in got] == [(1, 0.5, "x")] and 0 <= got[0]["score_"] <= 1


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "ok")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert linear.toxicity_scores(docs, labels).count() == 2
