"""Hashed n-gram logistic regressions: quality (FTRL) and toxicity (counterfactual).

Both learn from a bounded sample of labelled rows: the ``sample`` rows with the least
hash of their id among those the caller passes (fewer rows: all of them), and stop
reading at ``max_features`` features.  The bound is what allows one task to run the
sequential updates; scoring covers every whole text.  A model is a dense vector of
2^bits weights, so its broadcast size does not depend on the data.

Counterfactuals.  In one sentence of each labelled text that mentions groups, the terms are
swapped for others of their group, and a change of the score is penalised.  Which terms
are interchangeable is a parameter; ``derived_groups`` adds, from the sample, frequent words
that occur under both labels alike, grouped with those they share most documents with: they
say nothing about the label, so swapping them must not change a score either.

Nulls, ties, repeats: rows with a null label or id are not learnt from; a null or
empty text scores the bias; repeated documents are scored (and learnt) as often as
they occur; rows of equal hash are learnt from in the order of their text's hash; without
labelled rows every score is 0.5; columns besides the id and the text are never read by a
score, and pass through where they are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import SPACE, as_bytes, fresh, hash_words, mix64, prepare, rolled, slices, stored

#: Labelled rows that a model is fitted on at most, and features read for it at most.
SAMPLE = 20_000
MAX_FEATURES = 40_000_000

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)

#: Words that derived_groups considers at most, their least share of the documents of either
#: label, the greatest ratio of the two shares, the words of a group, and the least share of the
#: documents of two words of a group that have both.
TERMS, LEAST_SHARE, MOST_RATIO, GROUP, TOGETHER = 48, 0.05, 1.5, 4, 0.1

# Group mentions that carry no judgement by themselves.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "american", "mexican", "arab"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens"),
    ("frauen", "männer", "juden", "muslime", "christen"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos"),
)


def shape_of(word: bytes) -> bytes:
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


class Quality:
    """Counts of word and word-shape n-grams, as shares of the text's words."""

    bits, scale, binary = 20, 30.0, False

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = array("Q"), array("Q")

    def _codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of their shapes; those of words seen lately are kept."""
        if len(self.known) > 300_000:
            self._forget()
        known, digest, (word, shape) = self.known, xxhash.xxh64_intdigest, self.hashes
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            place = known.get(w)
            if place is None:
                place = known[w] = len(known)
                word.append(digest(w.lower(), 7))
                shape.append(digest(shape_of(w), 8))
            at[i] = place
        return tuple(np.frombuffer(x, np.uint64)[at] if len(x) else np.zeros(0, np.uint64) for x in self.hashes)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) of every occurrence."""
        flat: list[bytes] = []
        counts = []
        for text in texts:
            words = text.split()
            flat += words
            counts.append(len(words))
        owner = np.repeat(np.arange(len(texts)), counts)
        word, shape = self._codes(flat)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        shape = np.where(same, np.uint64(99), shape)
        parts, owners = [mix64(word), mix64(shape + np.uint64(1))], [owner, owner]
        for codes, k, salt in ((word, 2, 2), (shape, 2, 3), (shape, 3, 4)):
            run = rolled(codes, k) + np.uint64(salt)
            keep = owner[: len(run)] == owner[k - 1 :] if len(run) else np.zeros(0, bool)
            parts.append(mix64(run[keep]))
            owners.append(owner[: len(run)][keep])
        codes = np.concatenate(parts) & np.uint64((1 << self.bits) - 1)
        return np.concatenate(owners), codes.astype(np.int64)


class Toxic:
    """Presence of hashed word unigrams and bigrams, lower-cased and without edge punctuation."""

    bits, scale, binary = 22, 1.0, True
    edges = b".,;:!?\"'()[]*#%&$|"

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[bytes] = []
        counts = []
        for text in texts:
            words = text.lower().translate(None, self.edges).split()
            flat += words
            counts.append(len(words))
        owner = np.repeat(np.arange(len(texts)), counts)
        word = hash_words(flat, 7)
        pair = rolled(word, 2)
        keep = owner[: len(pair)] == owner[1:] if len(pair) else np.zeros(0, bool)
        codes = np.concatenate([mix64(word), mix64(pair[keep] + np.uint64(1))]) & np.uint64((1 << self.bits) - 1)
        both = np.unique((np.concatenate([owner, owner[: len(pair)][keep]]).astype(np.int64) << self.bits) | codes.astype(np.int64))
        return both >> self.bits, both & ((1 << self.bits) - 1)


_SENTENCE = re.compile(rb"[^.!?\n]*[.!?\n]*")


class Swaps:
    """Sentences with each of their group terms replaced by another of its group."""

    def __init__(self, groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> None:
        self.others: dict[bytes, tuple[list[bytes], int]] = {}
        for group in groups:
            terms = [t.encode() for t in dict.fromkeys(group)]
            if len(terms) > 1:
                self.others.update({t: (terms, i) for i, t in enumerate(terms)})

    def sentence(self, text: bytes, seed: int) -> bytes:
        """The sentence with its terms replaced; the same object where it has none."""
        words, hit = text.split(), False
        for i, word in enumerate(words):
            core = word.lower().translate(None, Toxic.edges)
            if core in self.others:
                group, at = self.others[core]
                words[i] = group[(at + 1 + (seed + i) % (len(group) - 1)) % len(group)]
                hit = True
        return b" ".join(words) if hit else text

    def pair(self, text: bytes, seed: int) -> tuple[bytes, bytes] | None:
        """One of the text's sentences with terms, and its counterfactual."""
        held = [m[0] for m in _SENTENCE.finditer(text) if any(w.lower().translate(None, Toxic.edges) in self.others for w in m[0].split())]
        if not held:
            return None
        own = held[seed % len(held)]
        return own, self.sentence(own, seed)


@dataclass(frozen=True)
class Settings:
    alpha: float
    beta: float
    l1: float
    l2: float
    passes: int
    #: Weight of (score change)^2 between a text and its counterfactual, on the logit.
    pairing: float = 0.0


QUALITY = Settings(alpha=0.3, beta=0.1, l1=0.002, l2=0.02, passes=4)
TOXIC = Settings(alpha=1.0, beta=1.0, l1=4.0, l2=0.0, passes=4, pairing=1.0)


class FTRL:
    """Follow-the-regularised-leader with a learning rate for each coordinate."""

    def __init__(self, bits: int, s: Settings) -> None:
        self.z, self.n, self.s = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), s

    def weights(self, at) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def step(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        before = self.n[at]
        after = before + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.s.alpha * w
        self.n[at] = after

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        self.step(at, (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x, w)

    def pair(self, at: np.ndarray, change: np.ndarray) -> None:
        """Penalise the change of the logit between a text and its counterfactual."""
        w = self.weights(at)
        self.step(at, 2 * self.s.pairing * (w @ change) * change, w)


def _sparse(features, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and values of each text; the last weight is the bias."""
    owner, code = features(texts)
    key, count = np.unique((owner.astype(np.int64) << 32) | code, return_counts=True)
    owner, code = key >> 32, key & 0xFFFFFFFF
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        part = slice(ends[i], ends[i + 1])
        x = np.ones(ends[i + 1] - ends[i]) if features.binary else count[part] * (features.scale / max(1, len(text.split())))
        out.append((np.append(code[part], 1 << features.bits), np.append(x, 1.0)))
    return out


class Model(NamedTuple):
    #: Weights (bias last), and the counterfactual pairs that took part in the fit.
    weights: np.ndarray
    pairs: int


def fit(texts_labels, features, s: Settings, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, max_features: int = MAX_FEATURES) -> Model:
    """A model from an iterable of (text, label)."""
    model, rows, read, swaps = FTRL(features.bits, s), [], 0, Swaps(groups)
    for i, (text, label) in enumerate(texts_labels):
        own = _sparse(features, [text])[0]
        change = None
        if s.pairing and (pair := swaps.pair(text, i)):
            (at, x), (other, y) = _sparse(features, list(pair))
            keys, where = np.unique(np.concatenate([at, other]), return_inverse=True)
            d = np.bincount(where, np.concatenate([x, -y]), len(keys))
            if d.any():
                change = (keys[d != 0], d[d != 0])
        # as counts: half the size of values, which are a count's multiples of the last feature's share
        unit = 1.0 if features.binary else features.scale / max(1, len(text.split()))
        counts = None if features.binary else np.rint(own[1][:-1] / unit).astype(np.uint32)
        if counts is not None and counts.max(initial=0) < 1 << 16:
            counts = counts.astype(np.uint16)
        rows.append((own[0].astype(np.int32), counts, unit, float(label), change))
        read += len(own[0])
        if read > max_features:
            break
    for k in range(s.passes):
        for j in np.random.default_rng(k).permutation(len(rows)):
            at, counts, unit, y, change = rows[j]
            model.learn(at, np.ones(len(at)) if counts is None else np.append(counts * unit, 1.0), y)
            if change is not None:
                model.pair(*change)
    return Model(model.weights(slice(None)).astype(np.float32), sum(change is not None for *_, change in rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(h, y, t): order, label and text of the labelled rows that a model is fitted on."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    least = stored(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id", "y").limit(sample))
    joined = docs.select("doc_id", as_bytes(F.col("text")).alias("t")).join(F.broadcast(least), "doc_id")  # sample rows of three numbers at most
    return stored(joined.select("h", "y", "t").orderBy("h", "y", F.xxhash64("t"), "t").limit(sample).repartition("h"))


def derived_groups(rows: DataFrame) -> list[list[str]]:
    """Groups of frequent words of the labelled texts that both labels have alike.

    At most ``TERMS`` words are looked at, so what the driver sees is a square of that size.
    """
    edges = F.translate(F.lower(F.col("t").cast("string")), Toxic.edges.decode(), "")
    words = stored(rows.select("y", F.array_distinct(F.split(edges, SPACE)).alias("words")))
    sizes = {r["y"]: r["count"] for r in words.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    share = [F.count_if(F.col("y") == y) / n for y, n in sorted(sizes.items())]
    shares = words.select("y", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(F.least(*share).alias("low"), F.greatest(*share).alias("high"))
    alike = shares.where((F.col("low") >= LEAST_SHARE) & (F.col("high") <= MOST_RATIO * F.col("low")))
    terms = [r["word"] for r in alike.orderBy(F.desc("low"), "word").limit(TERMS).collect()]
    if not terms:
        return []
    held = words.select(F.array_intersect("words", F.array(*[F.lit(t) for t in terms])).alias("held"))
    together = held.select("held", F.explode("held").alias("word")).groupBy("word").agg(*[F.count_if(F.array_contains("held", t)).alias(f"n{i}") for i, t in enumerate(terms)]).collect()
    common = {r["word"]: {t: r[f"n{i}"] for i, t in enumerate(terms)} for r in together}

    def overlap(a: str, b: str) -> float:
        return common[a][b] / (common[a][a] + common[b][b] - common[a][b])

    groups, left = [], list(terms)
    while left:
        first = left.pop(0)
        company = [t for t in left if overlap(first, t) >= TOGETHER]
        near = sorted(company, key=lambda t: (-overlap(first, t), t))[: GROUP - 1]  # noqa: B023
        left = [t for t in left if t not in near]
        if near:
            groups.append([first, *near])
    return groups


def learnt(docs: DataFrame, labels: DataFrame, label: str, features, s: Settings, groups: Sequence[Sequence[str]] | None = None, sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the bounded sample of labelled documents, in one task of an executor.

    Without ``groups``, the fixed identity terms and those derived from the sample are swapped.
    """
    rows = labelled_sample(docs, labels, label, sample)
    if s.pairing and groups is None:
        groups = [*IDENTITY_TERMS, *derived_groups(rows)]
    groups = groups or ()

    def run(batches):
        def pairs():
            for batch in batches:
                yield from zip((v.as_py() for v in batch.column(2)), batch.column(1).to_pylist(), strict=True)

        w, paired = fit(pairs(), features, s, groups, max_features)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], 0), pa.float32()), pa.array(np.append(np.zeros(len(at), int), paired), pa.int64())], names=["at", "w", "pairs"])

    out, paired = np.zeros((1 << features.bits) + 1, np.float32), 0
    ordered = rows.orderBy("h", "y", F.xxhash64("t"), "t").limit(sample).coalesce(1)
    for row in ordered.mapInArrow(run, "at int, w float, pairs long").toLocalIterator():
        if row["at"] < 0:
            paired = row["pairs"]
        else:
            out[row["at"]] = row["w"]
    return Model(out, paired)


def scored(docs: DataFrame, weights: np.ndarray, features, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score in (0, 1), as ``name``: sparse dot products over every whole text."""
    at = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))
    kept = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*kept, F.lit(0.0).alias(name)).schema

    def run(batches):
        w = np.zeros((1 << features.bits) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = [np.zeros(0)]
            for _, texts in slices(batch.column(len(keep))):
                owner, code = features(texts)
                z = np.bincount(owner, w[code], len(texts))
                if not features.binary:
                    z *= features.scale / np.maximum(1, [len(t.split()) for t in texts])
                out.append(1 / (1 + np.exp(-np.clip(z + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.concatenate(out))], names=[*keep, name])

    return docs.select(*kept, as_bytes(F.col(f"`{text}`")).alias(fresh(docs.columns, "bytes"))).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "score", sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> DataFrame:
    """Quality of every document, learnt from the given labelled rows."""
    prepare(docs.sparkSession)
    model = learnt(docs, labels, "quality", Quality(), QUALITY, sample=sample, max_features=max_features)
    return scored(docs, model.weights, Quality(), keep, name=name)


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "score", groups: Sequence[Sequence[str]] | None = None, sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> DataFrame:
    """Toxicity of every document; the penalty holds swaps of group terms to equal scores."""
    prepare(docs.sparkSession)
    model = learnt(docs, labels, "toxic", Toxic(), TOXIC, groups, sample, max_features)
    return scored(docs, model.weights, Toxic(), keep, name=name)


def accepted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")
