"""Matches against brute force over every window."""

import random
from collections import Counter

import pytest

from terrasift.llm import decontaminate as d


def words_of(t):
    return (t or "").encode().lower().translate(None, d.PUNCTUATION).split()


def grams(w):
    k = min(d.SHINGLE, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def plain(docs, items):
    out = {}
    for doc, text in docs:
        w = words_of(text)
        for item, body in items:
            target = words_of(body)
            if not target or not w:
                continue
            n = len(target)
            if len(w) < n:
                windows = [w]
            else:
                windows = [w[s : s + n] for s in range(len(w) - n + 1)]
            best = max(d.weighted_jaccard(grams(x), grams(target)) for x in windows)
            if best >= 0.8:
                out[doc, item] = round(best, 9)
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 60)))) for i in range(25)] + [(90, "three little words"), (91, ""), (92, None)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 300))]
        if i % 2:
            passage = rng.choice(items[:25])[1].split()
            if i % 3 == 0:
                passage = passage[:-1]
            if i % 5 == 0 and len(passage) > 45:
                passage[len(passage) // 2] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in passage]
        docs.append((i, " ".join(w)))
    docs += [(100, items[3][1]), (101, " ".join(items[4][1].split()[:-1])), (102, "so THREE, little words! here"), (103, None), (104, "")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = case(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in d.contaminated(df, bench).collect()}
    assert got == plain(docs, items)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = case(7)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.contaminated(df, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 2_000)
    assert sorted(map(tuple, d.contaminated(df, bench).collect())) == whole


def test_block_tables_reach_every_fingerprint_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(2)
    items = d.Items([b"a b c d e f g h i j k l"], 0.8)
    ((_, part, prints, tables),) = items.classes
    for r in range(d.RADIUS + 1):
        for _ in range(50):
            bits = rng.choice(64, r, replace=False)
            other = prints ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0))
            assert list(items.candidates(other, prints, tables)) == [(0, 0)] and part.tolist() == [0]


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "s"), (2, "nothing of the kind is in this text", "s"), (None, "null id", "s")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(5, "one two three four five six")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in d.clean(docs, bench).collect()) == ["2", "None"]
    assert d.clean(docs, bench.limit(0)).count() == 3 and d.clean(docs.limit(0), bench).count() == 0


def test_clean_judges_rows_by_text(spark):
    """A null id does not save a row, a shared id does not condemn one."""
    bench = spark.createDataFrame([(1, "these are the words of one benchmark item")], "item_id long, text string")
    rows = [(1, "a clean text"), (1, "these are the words of one benchmark item"), (None, "these are the words of one benchmark item"), (None, "clean too"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in d.clean(df, bench).collect()) == [("1", "a clean text"), ("2", "None"), ("None", "clean too")]


@pytest.mark.parametrize("seed", [2, 4])
def test_edited_passages_at_document_starts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(60, 200)))) for i in range(20)]
    docs, want = [], set()
    for doc in range(200):
        item, body = rng.choice(items)
        passage = body.split()
        for at in rng.sample(range(len(passage)), max(1, len(passage) // 60)):
            passage[at] = "changed"
        if d.weighted_jaccard(grams(words_of(" ".join(passage))), grams(words_of(body))) >= 0.8:
            want.add((doc, item))
        docs.append(" ".join(passage + [word() for _ in range(rng.randrange(30, 200))]).encode())
    block = d.Items([t.encode() for _, t in items], 0.8)
    assert {(doc, i) for doc, i, *_ in d.matches(docs, block)} == want and len(want) > 150


def test_edited_passages_inside_one_very_long_text():
    """Every item, edited down to nearly the threshold, at any offset of a text of 100,000 words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    text, want = [], set()
    for i, body in enumerate(items):
        passage = body.split()
        for _ in range(len(passage) // 50):
            passage[rng.randrange(len(passage))] = "changed"
        if d.weighted_jaccard(grams(words_of(" ".join(passage))), grams(words_of(body))) >= 0.8:
            want.add(i)
        text += passage + [word() for _ in range(rng.randrange(1500, 1700))]
    block = d.Items([t.encode() for t in items], 0.8)
    assert {i for _, i, *_ in d.matches([b"", " ".join(text).encode(), b"x"], block)} == want and len(want) > 50


def test_ids_of_any_type_repeated_items_and_other_columns(spark):
    docs = spark.createDataFrame([("a", "these are the words of one item", "c"), ("a", "these are the words of one item", "c"), ("b", None, "c")], "doc_id string, text string, item_id string")
    bench = spark.createDataFrame([("q-1", "These are the words of one item."), ("q-1", "These are the words of one item."), (None, "these are the words of one item"), ("q-2", "")], "item_id string, text string")
    got = d.contaminated(docs, bench)
    assert got.columns == ["doc_id", "item_id", "similarity", "first_word"]
    assert sorted(map(tuple, got.collect())) == [("a", "q-1", 1.0, 0)] * 2
    assert d.contaminated(docs, bench.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query over tables of the expected names."""
    from terrasift.llm.queries import op10_decontamination

    docs, items = case(11)
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in op10_decontamination(spark, str(tmp_path)).collect()}
    assert got == plain(docs, items)
