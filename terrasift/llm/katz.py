"""Bigram language model with Katz backoff, learnt and evaluated over whole corpora.

Tokens of a text: its words, lower-cased (A-Z), then one end mark.  Contexts: the token
before, or a start mark.  Counts r up to K are discounted by Good-Turing; a context's
backoff weight is its left-over mass over the unigram mass of its unseen tokens, so each
context's distribution sums to one over the vocabulary and one class of unknown words.
A context all of whose successors are frequent gives up one count of (count + 1).

Execution.  Documents are encoded once into batches (word hashes, local token numbers),
a bucketed table.  A batch asks the word table for its distinct words, and the bigram
table for its distinct pairs; both tables are partitioned by ranges of the (context)
word's hash and are built from what the batches send, already summed by batch.  The
answers come back to the batch by its number, and each token is then evaluated: seen
bigram, else backoff weight times unigram, else the unknown class.  No vocabulary or
model is collected or broadcast; only a few sums (counts of counts, totals) are.

Nulls, ties, repeats: a null text is empty and has the end mark alone; repeated rows are
documents of their own; an empty table gives an empty result; without training documents
every token is unknown with probability one; other columns are not read.
"""

from __future__ import annotations

import uuid
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import as_bytes, hash_words, mix64, prepare, slices, stored, tokens

K = 5
BATCH_TOKENS = 2_000_000
#: Distinct words, and distinct pairs before they meet, of a part of a table.
WORDS_PART, PAIRS_PART = 1_000_000, 1_500_000
END, START = (np.uint64(xxhash.xxh64_intdigest(x, 42)) for x in (b"", b"\n"))


def pack(x: np.ndarray) -> bytes:
    """A length, the size of the compressed bytes, and these."""
    data = pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)
    return len(x).to_bytes(8, "little") + len(data).to_bytes(8, "little") + data


def unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[16:], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted hashes as gaps, low and high halves apart (the high ones compress)."""
    gaps = np.diff(x, prepend=np.uint64(0))
    return pack((gaps & np.uint64(0xFFFFFFFF)).astype(np.uint32)) + pack((gaps >> np.uint64(32)).astype(np.uint32))


def unpack_sorted(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[8:16], "little")
    low, high = unpack(data[: 16 + size], np.uint32), unpack(data[16 + size :], np.uint32)
    return np.cumsum(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def pack_planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes: the higher planes compress."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel())


def unpack_planes(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts of any size: one byte tells whether four or eight bytes hold each."""
    kind = np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(x.astype(kind))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], {4: np.uint32, 8: np.uint64}[data[0]]).astype(np.int64)


def part_starts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range begins in sorted hashes; the last entry is their number."""
    edges = np.array([((1 << 64) * p) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def encoded(docs: DataFrame, train: Column) -> DataFrame:
    """One row a batch: ids, training flags, token counts, vocabulary, training counts, tokens."""
    kind = docs.schema["doc_id"].dataType
    schema = docs.select(F.lit(0).cast("long").alias("batch"), F.array(F.col("doc_id")).alias("ids"), F.lit(0).cast("long").alias("tokens"), *[F.lit(b"").alias(c) for c in ("train", "counts", "vocab", "seen", "local")]).schema
    narrow = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), as_bytes(F.col("text")).alias("text"))

    def emit(number: int, ids: list, flags: list[np.ndarray], counts: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        flag, count, word = np.concatenate(flags), np.concatenate(counts), np.concatenate(words)
        vocab, local = np.unique(np.append(word, START), return_inverse=True)
        local = local[:-1].astype(np.uint32)
        seen = np.bincount(local[np.repeat(flag, count)], minlength=len(vocab)).astype(np.uint32)
        columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(ids_type[0])), pa.array([len(word)], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(flag.astype(np.uint8)), pack(count.astype(np.uint32)), pack_sorted(vocab), pack(seen), pack_planes(local)))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    ids_type = [pa.int64()]

    def run(batches):
        number = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0
        ids, flags, counts, words, held = [], [], [], [], 0
        for batch in batches:
            ids_type[0] = batch.schema.field(0).type
            own_ids, own_flags = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for start, texts in slices(batch.column(2)):
                flat, count = tokens(texts)
                hashed = hash_words(flat)
                words.append(np.insert(hashed, np.cumsum(count), END))
                counts.append(count + 1)
                ids += own_ids[start : start + len(texts)]
                flags.append(own_flags[start : start + len(texts)])
                held += len(words[-1])
                if held >= BATCH_TOKENS:
                    yield emit(number, ids, flags, counts, words)
                    number, ids, flags, counts, words, held = number + 1, [], [], [], [], 0
        if ids:
            yield emit(number, ids, flags, counts, words)

    assert kind is not None
    return narrow.mapInArrow(run, schema)


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """A table in the shared warehouse, bucketed by batch: later joins leave it in place."""
    name = f"terrasift_{uuid.uuid4().hex}"
    df.write.option("compression", "none").bucketBy(buckets, "batch").saveAsTable(name)
    return df.sparkSession.table(name)


def rows_of(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0 to K (the first unused) from the counts of counts 1 to K + 1.

    Where they are no proper factors (small or odd data), r - 1/2 replaces r.
    """
    out = np.ones(K + 1)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


class Unigrams:
    """Discounted word probabilities and the probability of the unknown class."""

    def __init__(self, total: int, n: list[int]) -> None:
        self.total, self.factor = total, discounts(n)
        left = sum(n[r - 1] * r * (1 - self.factor[r]) for r in range(1, K + 1))
        self.scale = 1.0 if left > 0 or not total else total / (total + 1)
        self.unknown = left / total if left > 0 else 1 / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts <= K, self.factor[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, self.scale * factor * counts / max(1, self.total), self.unknown)


def ask_words(batches: DataFrame, parts: int) -> DataFrame:
    def run(arrow):
        for batch in arrow:
            for row in batch.to_pylist():
                vocab, seen = unpack_sorted(row["vocab"]), unpack(row["seen"], np.uint32)
                at = part_starts(vocab, parts)
                cut = [(p, at[p], at[p + 1]) for p in range(parts) if at[p + 1] > at[p]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cut], pa.int32()), pa.array([row["batch"]] * len(cut), pa.int64()), pa.array([pack_sorted(vocab[a:b]) for _, a, b in cut], pa.binary()), pa.array([pack(seen[a:b]) for _, a, b in cut], pa.binary())], names=["part", "batch", "words", "seen"])

    return batches.select("batch", "vocab", "seen").mapInArrow(run, "part int, batch long, words binary, seen binary")


def answer_words(requests: DataFrame) -> DataFrame:
    """The word table's counts for each batch; with batch -1 a part's sums: n1.., total, distinct."""

    def run(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        words = [unpack_sorted(r["words"]) for r in rows]
        _, where = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(where, np.concatenate([unpack(r["seen"], np.uint32) for r in rows])).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        answers = [pack(counts[where[e - len(w) : e]]) for w, e in zip(words, ends, strict=True)]
        rank = np.empty(len(counts), np.int64)  # a short name of each word: its place in the part by frequency
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        names = [pack_planes(rank[where[e - len(w) : e]]) for w, e in zip(words, ends, strict=True)]
        sums = [int((counts == r).sum()) for r in range(1, K + 2)] + [int(counts.sum()), int((counts > 0).sum())]
        return pa.table({"batch": pa.array([*(r["batch"] for r in rows), -1], pa.int64()), "part": pa.array([rows[0]["part"]] * (len(rows) + 1), pa.int32()), "answer": pa.array([*answers, b""], pa.binary()), "rank": pa.array([*names, b""], pa.binary()), "sums": pa.array([None] * len(rows) + [sums], pa.list_(pa.int64()))})

    return requests.groupBy("part").applyInArrow(run, "batch long, part int, answer binary, rank binary, sums array<long>")


def pairs_of(local: np.ndarray, counts: np.ndarray, start: int, size: int):
    """Distinct (context, token) pairs of a batch as keys in order, and the pair number of each token."""
    context = np.empty(len(local), np.int64)
    context[1:] = local[:-1]
    context[np.cumsum(counts) - counts] = start
    return np.unique(context * size + local, return_inverse=True)


def gathered(answers: list[dict], field: str, kind) -> np.ndarray:
    """A field of all parts' answers in their order; ``kind`` is what it is made of or what unpacks it."""
    read = kind if callable(kind) and not isinstance(kind, type) else lambda data: unpack(data, kind)
    found = [read(a[field]) for a in sorted(answers, key=lambda a: a["part"])]
    return np.concatenate(found) if found else read(pack_counts(np.zeros(0)) if read is kind else pack(np.zeros(0, kind)))


def ask_pairs(joined: DataFrame, parts: int) -> DataFrame:
    schema = "part int, batch long, contexts binary, fanout binary, word_part binary, word_rank binary, word_count binary, pair_count binary"

    def run(arrow):
        for batch in arrow:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocab, counts = unpack_sorted(row["vocab"]), unpack(row["counts"], np.uint32).astype(np.int64)
                word_counts = gathered(row["words"], "answer", np.int64)
                parts_of = [a for a in sorted(row["words"], key=lambda a: a["part"])]
                word_rank = np.concatenate([unpack_planes(a["rank"]) for a in parts_of])
                word_part = np.repeat(np.array([a["part"] for a in parts_of], np.uint32), [len(unpack(a["answer"], np.int64)) for a in parts_of])
                start = int(np.searchsorted(vocab, START))
                keys, where = pairs_of(unpack_planes(row["local"]), counts, start, len(vocab))
                train = np.repeat(unpack(row["train"], np.uint8).astype(bool), counts)
                pair_counts = np.bincount(where[train], minlength=len(keys)).astype(np.uint32)
                context, word = keys // len(vocab), keys % len(vocab)
                firsts = np.flatnonzero(np.diff(context, prepend=-1))
                owners = context[firsts]
                at = part_starts(vocab[owners], parts)
                edges = np.append(firsts, len(keys))
                out: list[list] = [[] for _ in range(8)]
                for p in range(parts):
                    a, b = at[p], at[p + 1]
                    if a == b:
                        continue
                    x, y = edges[a], edges[b]
                    w = word[x:y]
                    for column, value in zip(out, (p, row["batch"], pack_sorted(vocab[owners[a:b]]), pack(np.diff(edges[a : b + 1]).astype(np.uint32)), pack_planes(word_part[w]), pack_planes(word_rank[w]), pack_counts(word_counts[word[x:y]]), pack(pair_counts[x:y])), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["part", "batch", "contexts", "fanout", "word_part", "word_rank", "word_count", "pair_count"])

    return joined.mapInArrow(run, schema)


def answer_pairs(requests: DataFrame, unigrams: Unigrams) -> DataFrame:
    """For each batch: counts of its pairs; for its contexts whether it has rare successors
    and, where a pair of the batch backs off, their counts by count and the seen unigram mass.  With batch -1 a part's counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        contexts = [unpack_sorted(r["contexts"]) for r in rows]
        fanouts = [unpack(r["fanout"], np.uint32) for r in rows]
        names, where_context = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(where_context, np.concatenate(fanouts))
        word = (np.concatenate([unpack_planes(r["word_part"]) for r in rows]).astype(np.uint64) << np.uint64(32)) | np.concatenate([unpack_planes(r["word_rank"]) for r in rows])
        key = mix64(names[context] ^ mix64(word + np.uint64(1)))
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(where, np.concatenate([unpack(r["pair_count"], np.uint32) for r in rows])).astype(np.int64)
        owner = context[first]
        mass = np.where(counts > 0, unigrams(np.concatenate([unpack_counts(r["word_count"]) for r in rows])[first]), 0.0)
        mass = np.bincount(owner, mass, len(names))
        rare = [np.bincount(owner[counts == r], minlength=len(names)).astype(np.uint32) for r in range(1, K + 1)]
        some_rare = sum(rare) > 0
        answers: list[list[bytes]] = [[], [], [], []]
        a = x = 0
        for c, f in zip(contexts, fanouts, strict=True):
            b, y = a + len(c), x + int(f.sum())
            own = where_context[a:b]
            found = counts[where[x:y]]
            backs_off = np.bincount(np.repeat(np.arange(b - a), f), found == 0, b - a) > 0  # only these need weights
            answers[0].append(pack_counts(found))
            answers[1].append(pack((some_rare[own] + 2 * backs_off).astype(np.uint8)))
            answers[2].append(pack(np.stack([r[own[backs_off]] for r in rare], axis=1).ravel()))
            answers[3].append(pack(mass[own[backs_off]]))
            a, x = b, y
        sums = [int((counts == r).sum()) for r in range(1, K + 2)]
        n = len(rows)
        return pa.table({"batch": pa.array([*(r["batch"] for r in rows), -1], pa.int64()), "part": pa.array([rows[0]["part"]] * (n + 1), pa.int32()), **{k: pa.array([*v, b""], pa.binary()) for k, v in zip(("counts", "state", "rare", "mass"), answers, strict=True)}, "sums": pa.array([None] * n + [sums], pa.list_(pa.int64()))})

    return requests.groupBy("part").applyInArrow(run, "batch long, part int, counts binary, state binary, rare binary, mass binary, sums array<long>")


def totals(answers: DataFrame, n: int) -> list[int]:
    row = answers.where("batch = -1").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(f"s{i}") for i in range(n)]).first()
    return [int(x) for x in row]


def token_scores(pair_count, no_rare, rare, mass, context_total, word_count, unigrams: Unigrams, factor: np.ndarray) -> np.ndarray:
    """log10 probabilities of distinct pairs: the recursion of one token.

    ``no_rare`` tells contexts whose successors are all frequent; ``rare`` has a row of
    successors with counts 1 to K and ``mass`` the unigram mass of the seen successors, both
    where the context backs off; ``context_total`` are the context's occurrences.
    """
    total = np.maximum(context_total, 1)
    left = (rare * (np.arange(1, K + 1) * (1 - factor[1:]))).sum(1) / total
    frequent = no_rare & (context_total > 0)
    seen = np.where(pair_count <= K, factor[np.minimum(pair_count, K)], 1.0) * pair_count / total
    seen = np.where(frequent, seen * context_total / (context_total + 1), seen)
    left = np.where(frequent, 1 / (context_total + 1), left)
    weight = np.where(context_total > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    return np.log10(np.where(pair_count > 0, seen, weight * unigrams(word_count)))


def scores(joined: DataFrame, unigrams: Unigrams, distinct: int, documents: int, factor: np.ndarray, schema) -> DataFrame:
    def run(arrow):
        for batch in arrow:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocab, counts = unpack_sorted(row["vocab"]), unpack(row["counts"], np.uint32).astype(np.int64)
                word_counts = gathered(row["words"], "answer", np.int64)
                local = unpack_planes(row["local"]).astype(np.int64)
                start = int(np.searchsorted(vocab, START))
                keys, where = pairs_of(local, counts, start, len(vocab))
                context, word = keys // len(vocab), keys % len(vocab)
                contexts, of = np.unique(context, return_inverse=True)
                total = word_counts[contexts]
                total[contexts == start] = documents
                pair_count = gathered(row["pairs"], "counts", unpack_counts)
                state = gathered(row["pairs"], "state", np.uint8)
                rare, mass = np.zeros((len(contexts), K)), np.zeros(len(contexts))
                rare[state >= 2] = gathered(row["pairs"], "rare", np.uint32).reshape(-1, K)
                mass[state >= 2] = gathered(row["pairs"], "mass", np.float64)
                logs = token_scores(pair_count, (state & 1)[of] == 0, rare[of], mass[of], total[of], word_counts[word], unigrams, factor)
                at = np.cumsum(counts) - counts
                known = word_counts[local]
                base = np.log10((known + 0.5) / (unigrams.total + 0.5 * (distinct + 1)))
                n = len(counts)
                held = ~unpack(row["train"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(held), pa.array(counts), pa.array(np.add.reduceat((known > 0).astype(np.int64), at)), pa.array(np.full(n, unigrams.total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs[where], at))], names=schema.names)

    return joined.mapInArrow(run, schema)


def answers_by_batch(answers: DataFrame, name: str, *fields: str) -> DataFrame:
    return answers.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("part", *fields)).alias(name))


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from the rows where ``train`` is true.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = docs.select("doc_id", F.lit(True).alias("held_out"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    batches = encoded(docs, train)
    batches = bucketed(batches, max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = batches.agg(F.coalesce(F.sum(F.length("vocab")), F.lit(0)), F.coalesce(F.count("*"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    word_parts = max(1, ceil(size[0] / 6 / WORDS_PART))
    pair_parts = max(1, ceil(size[2] / PAIRS_PART))
    words = stored(answer_words(ask_words(batches, word_parts)))
    *n, total, distinct = totals(words, K + 3)
    unigrams = Unigrams(total, n)
    documents = batches_documents(batches)
    by_batch = answers_by_batch(words, "words", "answer")
    named = answers_by_batch(words, "words", "answer", "rank")
    requests = ask_pairs(batches.select("batch", "train", "counts", "vocab", "local").join(named, "batch"), pair_parts)
    pairs = stored(answer_pairs(requests, unigrams))
    factor = discounts(totals(pairs, K + 1))
    whole = batches.join(by_batch, "batch").join(answers_by_batch(pairs, "pairs", "counts", "state", "rare", "mass"), "batch")
    return scores(whole, unigrams, distinct, documents, factor, schema)


def batches_documents(batches: DataFrame) -> int:
    """The number of training documents: the occurrences of the start mark as a context."""

    def run(arrow):
        for batch in arrow:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x, np.uint8).sum()) for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return int(batches.select("train").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
