"""Language identification by language-bitmask n-gram filters.

Learning.  Character 3- and 4-grams of the lower-cased text (runs of non-letters are one
blank, and a blank may only stand at an n-gram's edge) are hashed to ``CODE_BITS`` bits
and counted for each language over all learnt documents.  A language owns an n-gram if
it is at least ``SHARE`` times as frequent there as in the language where it is most
frequent, which keeps wrong labels and foreign passages out of the filters.

Filter.  A bit-sliced Bloom filter: each slot is a bitmask over languages, an n-gram sets
its languages' bits in HASHES slots, and the AND of its slots returns at once all
languages that contain it.  A text's count of hits for a language is corrected for the
filter's false positives, (hits - n f) / (1 - f) with f = fill ** HASHES; the largest
corrected count decides and its share of all is the score.

The filter's size is fixed by ``SLOT_BITS`` whatever the corpus, so it may be broadcast;
more than 63 languages take further words of bits.

Nulls, ties, repeats: texts without letters (null, empty) are ``und`` with score 0; rows
with a null language are not learnt from; equal counts go to the language whose name
comes first; texts that hit nothing get the commonest learnt language with score 0; with
nothing learnt everything is ``und``; repeated rows count and come out as often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import mix64, prepare, slices, stored

CODE_BITS, SLOT_BITS, HASHES = 24, 20, 3
SHARE = 0.3
WORD = 63

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, as a table over all of Unicode."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, code) of every n-gram, and whether each text has a letter."""
    parts = [np.frombuffer((" " + t.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    points = np.concatenate(parts)
    letter = letters()[points]
    keep = letter | np.append(letter[1:], False) | np.insert(letter[:-1], 0, False)  # blanks only beside letters
    points, letter, owner = np.where(letter, points, 32)[keep].astype(np.uint64), letter[keep], owner[keep]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    owners, codes = [], []
    for n in (3, 4):
        m = max(0, len(points) - n + 1)
        code, inner = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[j : j + m]
            if 0 < j < n - 1:
                inner &= letter[j : j + m]
        owners.append(owner[:m][inner])
        codes.append(mix64(code[inner]) >> np.uint64(64 - CODE_BITS))
    return np.concatenate(owners), np.concatenate(codes), has


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    spread = [mix64(codes + np.uint64(1 + (i << CODE_BITS))) for i in range(HASHES)]
    return [(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for s in spread]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all documents with a language: summed by worker, then by Spark."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(pairs):
            codes, where = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([n for _, n in pairs])).astype(np.int64)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for start, texts in slices(batch.column(1)):
                owner, codes, _ = ngrams(texts)
                own = langs[start : start + len(texts)]
                for lang in sorted(set(own)):
                    pairs = held.setdefault(lang, [])
                    pairs.append(np.unique(codes[(own == lang)[owner]], return_counts=True))
                    if len(pairs) > 16:
                        held[lang] = [folded(pairs)]
        for lang, pairs in held.items():
            codes, n = folded(pairs)
            for a in range(0, len(codes), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(n[part])], names=["lang", "code", "n"])

    narrow = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("binary").alias("t"))
    return narrow.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], str | None, np.ndarray]:
    """Languages by name, the commonest, and the slots: one row of bitmasks for 63 languages."""
    prepare(docs.sparkSession)
    counts = stored(counted(docs))
    sums = sorted((r["lang"], r["s"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("s")).collect())
    names = [lang for lang, _ in sums]
    width = max(1, -(-len(names) // WORD))
    slots = np.zeros((width, 1 << SLOT_BITS), np.uint64)
    if not names:
        return names, None, slots
    known = docs.sparkSession.createDataFrame([(lang, i, float(s)) for i, (lang, s) in enumerate(sums)], "lang string, i int, s double")
    rate = F.col("n") / F.col("s")
    owned = counts.join(F.broadcast(known), "lang").withColumn("rate", rate).withColumn("most", F.max(rate).over(Window.partitionBy("code"))).where(F.col("rate") >= SHARE * F.col("most"))
    masks = owned.groupBy("code", F.floor(F.col("i") / WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(i % {WORD} as int))")).alias("mask"))

    def place(batches):
        for batch in batches:
            codes = np.array(batch.column(0), np.int64).astype(np.uint64)
            for at in slots_of(codes):
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1), batch.column(2)], names=["slot", "word", "mask"])

    placed = masks.select("code", "word", "mask").mapInArrow(place, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    for row in placed.toLocalIterator(prefetchPartitions=True):
        slots[row["word"], row["slot"]] = row["mask"]
    for kind in (np.uint8, np.uint16, np.uint32):  # no wider than the languages need: what is looked up stays in the cache
        if len(names) <= 8 * np.dtype(kind).itemsize:
            slots = slots.astype(kind)
            break
    return names, max(sums, key=lambda x: x[1])[0], slots


def corrected(hits: np.ndarray, n: np.ndarray, slots: np.ndarray, languages: int) -> np.ndarray:
    """Hits by text and language without what the filter's false positives add."""
    one = slots.dtype.type(1)
    fill = np.array([((slots[i // WORD] >> slots.dtype.type(i % WORD)) & one).mean() for i in range(languages)])
    false = fill**HASHES
    return np.maximum(0.0, (hits - n[:, None] * false) / np.maximum(1e-9, 1 - false))


def identified(texts: list[bytes], names: list[str], commonest: str | None, slots: np.ndarray) -> tuple[list[str], np.ndarray]:
    owner, codes, has = ngrams(texts)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    at = slots_of(codes)
    hits = np.zeros((len(texts), len(names)))
    for w in range(len(slots)):
        mask = slots[w][at[0]]
        for a in at[1:]:
            mask = mask & slots[w][a]
        for i in range(w * WORD, min(len(names), (w + 1) * WORD)):
            bit = (mask >> mask.dtype.type(i % WORD)) & mask.dtype.type(1)
            hits[:, i] = np.bincount(owner, bit, len(texts))
    found = corrected(hits, np.bincount(owner, minlength=len(texts)), slots, len(names))
    total = found.sum(1)
    best = found.argmax(1)
    label = [("und" if not h else names[b] if t > 0 else commonest) for h, b, t in zip(has, best, total, strict=True)]
    return label, np.where(has & (total > 0), found.max(1) / np.maximum(total, 1e-300), 0.0)


def predict(docs: DataFrame, model: tuple[list[str], str | None, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            labels, found = [], [np.zeros(0)]
            for _, texts in slices(batch.column(1), 2_000_000):
                label, score = identified(texts, *shared.value)
                labels += label
                found.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(np.concatenate(found))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).mapInArrow(run, schema)
