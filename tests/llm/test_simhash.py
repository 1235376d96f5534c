"""Fingerprints and classes against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from terrasift.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius=4):
    """Least id of the class by repeated flooding over distinct fingerprints."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    return [(doc, f"{p:016x}", least.get(root(p))) for doc, p in prints]


def corpus():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "déjà", "ÇA", "x", "longer-word"]
    base = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "edit"
        near.append("  ".join(w))
    texts = [*base, *near, *base[:10], "", None, "one", "two words", "\x0b\x0c a\tb\nc d e", "é" * 5000]
    return [(i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus() + [(None, "alone in the null row"), (None, "one")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_over_made_fingerprints(spark, seed):
    """Dense groups and chains of fingerprints: every class is found."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 30])):
            prints.add(p)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(sign(p),) for p in prints], "fp long")
    got = {r["fp"] % (1 << 64): r["root"] for r in simhash.fingerprint_classes(nodes).collect()}
    want = {int(h, 16): c for c, h, c in plain_components([(p, p) for p in prints])}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_bound_holds():
    """The distance of the popcount vectors never exceeds the Hamming distance."""
    rng = random.Random(1)
    count = lambda p: [(p >> 2 * i & 3).bit_count() for i in range(32)]
    for _ in range(500):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        assert sum(abs(x - y) for x, y in zip(count(a), count(b), strict=True)) <= (a ^ b).bit_count()


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "other words are here now", "s"), (None, "null id text", "s")], "doc_id long, text string, source string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == ["1", "2", "None"]
    assert simhash.keep_one(df.limit(0)).collect() == [] and simhash.keep_one(df).columns == df.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert len({got[i] for i in range(51)}) == 1 and got[100] == got[101] != got[0]
    assert simhash.components(df.where(F.lit(False))).collect() == []


def test_keep_one_decides_by_row(spark):
    """Null and repeated ids: only true copies go."""
    texts = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "first text of no id at all"), (None, "quite another one without id"), (None, "quite another one without id"), (2, "one id with this text here"), (2, "and the same id with other words"), (2, "a b c d e f")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in simhash.keep_one(df).collect())))
    assert got == sorted(map(str, {t for t in texts if t not in [(None, "a b c d e f"), (2, "a b c d e f")]}))
