"""The language model against a plain one, on a small corpus."""

import math
from collections import Counter

import numpy as np
import pytest

from terrasift.llm import katz

TEXTS = ["a b a b c", "a b c d a b", "b b b a", "A c a b", "", None, "zz yy a b zz", "c\td e\x0bf a b", "a b " * 30]


def plain(rows):
    """(base, score) of each text by the definition, with dictionaries."""
    sentences = [[*((t or "").encode().lower().split()), "END"] for t, _ in rows]
    uni, bi = Counter(), Counter()
    for s, (_, train) in zip(sentences, rows, strict=True):
        if train:
            uni.update(s)
            bi.update(zip(["START", *s], s))
    contexts = Counter()
    for (c, _), n in bi.items():
        contexts[c] += n
    total, v = sum(uni.values()), len(uni)
    count_of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    unigrams, factor = katz.Unigrams(total, count_of(uni)), katz.discounts(count_of(bi))
    pu = lambda w: float(unigrams(np.array([uni[w]]))[0])

    def p(c, w):
        if not contexts[c]:
            return pu(w)
        seen = {x: n for (y, x), n in bi.items() if y == c}
        d = {x: n * (factor[n] if n <= katz.K else 1) / contexts[c] for x, n in seen.items()}
        if all(n > katz.K for n in seen.values()):
            d = {x: n / (contexts[c] + 1) for x, n in seen.items()}
        if w in d:
            return d[w]
        return (1 - sum(d.values())) / (1 - sum(pu(x) for x in d)) * pu(w)

    out = []
    for s in sentences:
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (v + 1))) for w in s)
        out.append((len(s), sum(uni[w] > 0 for w in s), total, base, sum(math.log10(p(c, w)) for c, w in zip(["START", *s], s))))
    for c in [*contexts, "never seen"]:  # each distribution sums to one over the vocabulary and the unknown class
        assert math.isclose(sum(p(c, w) for w in [*uni, "unknown"]), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_scores(spark, monkeypatch, parts):
    if parts > 1:  # many batches and parts
        monkeypatch.setattr(katz, "WORDS_PART", 3)
        monkeypatch.setattr(katz, "PAIRS_PART", 20)
        monkeypatch.setattr(katz, "BATCH_TOKENS", 40)
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, t, k, "x") for i, t, k in rows], "doc_id long, text string, k boolean, batch string").repartition(3)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in katz.score(docs, F.col("k")).collect()}
    for (i, _, train), want in zip(rows, plain([(t, k) for _, t, k in rows]), strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (*want[:3], not train)
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9, abs_tol=1e-9)


def test_empty_and_untrained(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert katz.score(docs.limit(0), F.lit(True)).collect() == []
    got = katz.score(docs, F.lit(False)).collect()
    assert len(got) == 2 and all(r["score"] == 0 and r["train_tokens"] == 0 for r in got)


def test_counts_of_any_size():
    """Counts beyond 32 bits come back as they are."""
    for counts in ([], [0, 1, 7], [5_000_000_000, 3, (1 << 40) + 1]):
        assert katz.unpack_counts(katz.pack_counts(np.array(counts, np.int64))).tolist() == counts


def test_very_long_text_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b " * 100_000, True), (1, "a b", True), (None, "b", False)], "doc_id long, text string, k boolean")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in katz.score(docs, F.col("k")).collect())
    assert got == [("1", 3, 3), ("1", 200_001, 200_001), ("None", 2, 2)]
