"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased (A-Z) after deletion of punctuation; shingles have five words (an
item of fewer words is one shingle).  Every document is read in windows as long as each
benchmark item, a window starting at each word.  A window of n shingles at a weighted
(multiset) Jaccard similarity t to an item of n shingles has 2 t n / (1 + t) of its
shingles in common with it, so prefix sums of the shingles that any item has rule out,
for certain, windows that are not near an item.  The rest get fingerprints, the bit-wise
majority of their shingles' hashes.  Multi-index blocks: the 64 bits form eight blocks,
and a fingerprint within ``RADIUS`` of an item's differs in one block by RADIUS // 8 bits
at most, so eight tables of 256 entries return every such item.  Each candidate is then
verified by the exact weighted similarity of the shingles.

At the threshold itself the fingerprints of a window and an item differ in about ten of
64 bits with a deviation of three; the radius is four and a half deviations above.

Items come to the executors in blocks of ``BLOCK_BYTES`` of text (an item may exceed it)
by a hash of the item, so what is broadcast is bounded and a larger benchmark takes more
passes over the documents.

Nulls, ties, repeats: a null or empty text or item matches nothing; an item without an id
is left out; repeated items count once, repeated documents give repeated results; a
document shorter than an item is compared as a whole; of equally similar windows the first
is reported; an empty table gives an empty result; ids may be of any type and other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import as_bytes, hash_words, prepare, rolled, slices, stored, tokens

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCK_BYTES = 4_000_000
PUNCTUATION = b".,;:!?\"'()[]"


def shingles(words: np.ndarray) -> np.ndarray:
    return rolled(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def needed(n: int, m: int, threshold: float) -> int:
    """Shingles that multisets of n and m have in common at least at the threshold (a rounding error below it)."""
    return max(1, ceil(threshold * (n + m) / (1 + threshold) - 1e-9))


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """The bit-wise majority of each row of hashes."""
    bits = np.unpackbits(np.ascontiguousarray(windows).view(np.uint8).reshape(*windows.shape, 8), axis=2)
    return np.packbits(2 * bits.sum(1, dtype=np.int64) > windows.shape[1], axis=1).view(np.uint64).ravel()


class Items:
    """The items of a block by their number of words, with the block tables."""

    def __init__(self, texts: list[bytes], threshold: float) -> None:
        flat, counts = tokens(texts, PUNCTUATION)
        words, at = hash_words(flat), np.concatenate(([0], np.cumsum(counts)))
        self.threshold, self.hashes = threshold, []
        by_length: dict[int, list[int]] = {}
        prints = np.zeros(len(texts), np.uint64)
        for i in range(len(texts)):
            own = shingles(words[at[i] : at[i + 1]])
            self.hashes.append(Counter(own.tolist()))
            if len(own):
                prints[i] = fingerprints(own[None, :])[0]
                by_length.setdefault(int(counts[i]), []).append(i)
        self.every = np.array(sorted({h for c in self.hashes for h in c}), np.uint64)
        self.low_bits = np.zeros(1 << max(16, (8 * len(self.every)).bit_length()), bool)
        self.low_bits[self.every & np.uint64(len(self.low_bits) - 1)] = True
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // 8
        #: (words, items, fingerprints, eight tables of near items) of each length
        self.classes = []
        for length, members in sorted(by_length.items()):
            part = np.array(members)
            blocks = prints[part].view(np.uint8).reshape(-1, 8)
            self.classes.append((length, part, prints[part], [near[:, blocks[:, b]] for b in range(8)]))
        #: the least a document has in common with any item that it matches, by the words of a shingle
        self.least: dict[int, int] = {}
        for length in by_length:
            k = min(SHINGLE, length)
            least = max(1, ceil(threshold * (length - k + 1) - 1e-9))
            self.least[k] = min(least, self.least.get(k, least))

    def known(self, own: np.ndarray) -> np.ndarray:
        """Prefix sums of whether some item has each shingle."""
        has = self.low_bits[own & np.uint64(len(self.low_bits) - 1)]
        may = np.flatnonzero(has)
        if len(may):
            has[may] = self.every[np.minimum(np.searchsorted(self.every, own[may]), len(self.every) - 1)] == own[may]
        return np.concatenate(([0], np.cumsum(has, dtype=np.int64)))

    def candidates(self, fps: np.ndarray, own: np.ndarray, tables: list[np.ndarray]):
        """(window number, place in the class) within the radius, found by the block tables."""
        blocks = fps.view(np.uint8).reshape(-1, 8)
        met = tables[0][blocks[:, 0]]
        for b in range(1, 8):
            met = met | tables[b][blocks[:, b]]
        window, item = np.nonzero(met)
        near = np.bitwise_count(fps[window] ^ own[item]) <= RADIUS
        return zip(window[near].tolist(), item[near].tolist(), strict=True)


def document_matches(words: np.ndarray, items: Items) -> dict[int, tuple[float, int]]:
    """{item: (similarity, first word)} of a document given by its words' hashes."""
    best: dict[int, tuple[float, int]] = {}
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    threshold = items.threshold

    def verify(own: np.ndarray, i: int, first: int) -> None:
        found = weighted_jaccard(Counter(own.tolist()), items.hashes[i])
        if found >= threshold and found > best.get(i, (0.0, 0))[0]:
            best[i] = (found, first)

    for length, part, prints, tables in items.classes:
        k = min(SHINGLE, length)
        if k not in runs:
            own = rolled(words, k)
            runs[k] = own, items.known(own)
        (own, known), n = runs[k], length - k + 1
        if len(words) >= length:
            starts = np.flatnonzero(known[n:] - known[:-n] >= needed(n, n, threshold))
            step = max(1, 500_000 // max(n, len(part)))
            for a in range(0, len(starts), step):
                at = starts[a : a + step]
                for w, j in items.candidates(fingerprints(own[at[:, None] + np.arange(n)]), prints, tables):
                    verify(own[at[w] : at[w] + n], int(part[j]), int(at[w]))
        elif len(words):  # the whole text against a longer item
            whole = shingles(words)
            m = len(whole)
            if m >= needed(m, n, threshold):
                for _, j in items.candidates(fingerprints(whole[None, :]), prints, tables):
                    verify(whole, int(part[j]), 0)
    return best


def matches(texts: list[bytes], items: Items):
    """(text number, item number, similarity, first word) of each item found in each text."""
    flat, counts = tokens(texts, PUNCTUATION)
    words = hash_words(flat)
    ends = np.cumsum(counts)
    may = np.zeros(len(texts), bool)
    for k, least in items.least.items():  # shingles over the end of a text only let more texts through
        own = rolled(words, k)
        known = items.known(own)
        may |= known[np.minimum(ends, len(own))] - known[np.minimum(ends - counts, len(own))] >= least
    for doc in np.flatnonzero(may).tolist():
        best = document_matches(words[ends[doc] - counts[doc] : ends[doc]], items)
        yield from ((doc, i, *found) for i, found in sorted(best.items()))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity and first word of the best window of each match."""
    spark = docs.sparkSession
    prepare(spark)
    items = stored(benchmark.select("item_id", as_bytes(F.col("text")).alias("text")).where("item_id is not null").distinct())
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    schema = docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word")).schema
    narrow = docs.select("doc_id", as_bytes(F.col("text")).alias("text"))
    blocks = max(1, ceil(size / BLOCK_BYTES))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast(part.toArrow())

        def run(batches, shared=shared):
            ids, texts = (shared.value.column(i).combine_chunks() for i in range(2))
            block = Items(texts.to_pylist(), threshold)
            for batch in batches:
                rows = [(start + doc, *found) for start, held in slices(batch.column(1)) for doc, *found in matches(held, block)]
                at, which, found, first = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(which, pa.int64())), pa.array(found, pa.float64()), pa.array(first, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without a match, all columns as given; each row is judged by its text alone, whatever its id."""
    row = F.xxhash64(docs["text"])
    bad = stored(contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("_row")).distinct())
    return docs.join(bad, row == bad["_row"], "left_anti")
