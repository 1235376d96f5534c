"""SimHash near-duplicate detection by a segment-popcount embedding.

Fingerprint.  The bit-wise majority of the XXH64 values (seed 42) of the 4-word
shingles, repeats included.  A text of fewer words gives its whole word sequence as
the one shingle; a text without words (null included) has fingerprint zero.

Search.  The 64 bits are cut into 32 segments of two bits; a fingerprint becomes the
vector of the segments' popcounts (0, 1 or 2), packed into one long.  Changing a bit
moves the vector by one, so the Manhattan distance of two vectors is a lower bound of
the Hamming distance.  The segments form g groups: two vectors within distance r are
equal in g - r of them at least.  A cell of the grid is one choice of g - r groups with
their popcounts, so fingerprints within r share a cell, and those that share one are
verified by the exact distance.  More groups make more, smaller cells; g is the least at
which a cell is expected to hold ``CELL`` fingerprints or fewer, so the number of candidates
grows with the rows and not with their square, and the result is the same for every g.

Dense groups.  Only distinct fingerprints are searched.  Before the grid join, chains
over three sort orders link what is close already.  In a cell the fingerprints of its
largest class are not compared with each other, only what is left of the cell with all of
it, so thousands of near copies give no square of pairs while no link between two classes
is lost.  Classes come from contraction by minimum neighbour over randomly ordered nodes,
which halves the graph in each round.

Nulls, ties, repeats: a null id keeps its row and is ignored for component ids unless
the class has no other; repeated rows come out once each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import as_bytes, chained, prepare, slices, stored

RADIUS = 4
SEGMENTS = 32
#: Fingerprints expected in a cell at most, and groups of segments at most.
CELL, MOST_GROUPS = 8, 12
#: Segments whose popcounts begin each of the three orders of the chains.
ORDERS = ((0, 11), (11, 22), (22, 32))


def fingerprints_of(texts: list[bytes], k: int = 4) -> np.ndarray:
    """Fingerprints as uint64."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        before = len(hashes)
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends[: len(words) - k + 1] - [len(w) + 1 for w in words[: len(words) - k + 1]]).tolist()
            hashes += [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
        elif words:
            hashes.append(digest(b" ".join(words), 42))
        counts[i] = len(hashes) - before
    return majority(np.array(hashes, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each run of so many hashes; 0 for a run of none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a (signed) long."""
    narrow = df.select(*keep, as_bytes(F.col(text)).alias("_text"))
    schema = df.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            found = [fingerprints_of(texts) for _, texts in slices(column)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return narrow.mapInArrow(run, schema)


def popcounts(fp: Column) -> Column:
    """The packed vector: 32 fields of two bits, each the popcount of two bits of the fingerprint."""
    odd = F.lit(0x5555555555555555).cast("long")
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _mask(segments: Iterable[int]) -> int:
    return sum(3 << (2 * i) for i in segments)


def grid(rows: int, radius: int, most: int = MOST_GROUPS) -> list[int]:
    """The masks of the grid's choices of segment groups for so many fingerprints.

    A segment's popcount has 1.5 bits of entropy, so a choice of s segments has 2^(1.5 s) cells.
    """
    for g in range(radius + 2, most + 1):
        if rows <= CELL * 2 ** (1.5 * SEGMENTS * (g - radius) / g):
            break
    groups = np.array_split(np.arange(SEGMENTS), g)
    return [_mask(np.concatenate(chosen).tolist()) for chosen in combinations(groups, g - radius)]


def cells(vector: Column, masks: list[int]) -> Column:
    """(g, cell) of a vector for each choice of groups."""
    return F.array(*[F.struct(F.lit(g).alias("g"), vector.bitwiseAND(_long(m)).alias("cell")) for g, m in enumerate(masks)])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), roots being nodes of the same class.

    Each round maps every node to its least neighbour or itself in the order of a hash of
    the node, rewrites the edges and drops loops.  Node tables stay distributed.
    """
    order = lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), order(F.col("a")))["x"].alias("root")))
        maps.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def chains(nodes: DataFrame, radius: int) -> DataFrame:
    """Links of neighbours that share the popcounts of a third of the segments, in three orders."""

    def links(before: pa.Table, after: pa.Table) -> pa.Table:
        a, b = (np.asarray(t.column("fp")).astype(np.int64) for t in (before, after))
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        return pa.table({"a": b[near], "b": a[near]})

    out = None
    for g, group in enumerate(ORDERS):
        cell = popcounts(F.col("fp")).bitwiseAND(_long(_mask(range(*group))))
        turned = F.shiftleft("fp", 21 * g).bitwiseOR(F.shiftrightunsigned("fp", 64 - 21 * g)) if g else F.col("fp")
        linked = chained(nodes.select("fp", cell.alias("cell"), turned.alias("turned")), ["cell", "turned"], "cell", links, "a long, b long")
        out = linked if out is None else out.union(linked)
    return out


def cell_links(labelled: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b): roots of two classes with fingerprints within the radius, from (fp, root)."""
    placed = labelled.select("fp", "root", F.inline(cells(popcounts(F.col("fp")), masks)))
    sizes = placed.groupBy("g", "cell", "root").count().groupBy("g", "cell").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("count", "root")).alias("largest"))
    mixed = stored(placed.join(sizes.where("roots > 1").select("g", "cell", "largest"), ["g", "cell"]))
    rest = mixed.where("root <> largest").select("g", "cell", F.col("fp").alias("fa"), F.col("root").alias("ra"))
    every = mixed.select("g", "cell", F.col("fp").alias("fb"), F.col("root").alias("rb"))
    met = rest.join(every, ["g", "cell"]).where((F.col("ra") != F.col("rb")) & (distance(F.col("fa"), F.col("fb")) <= radius))
    return met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def fingerprint_classes(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``nodes``."""
    first = stored(components(chains(nodes, radius)))
    labelled = stored(nodes.join(first.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    second = stored(components(cell_links(labelled, grid(labelled.count(), radius), radius)))
    joined = labelled.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return joined.select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the class)."""
    prepare(docs.sparkSession)
    prints = stored(with_fingerprint(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = fingerprint_classes(nodes.select("fp"), radius)
    named = stored(nodes.join(classes, "fp").select("fp", "root", "least"))
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))  # stored: the join may then split a large class
    by_fp = stored(named.join(least, "root").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_hash(docs: DataFrame) -> Column:
    """What tells rows of one id, or of none, apart: a hash of the text."""
    return F.xxhash64(docs["text"])


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that come first in their class; ``rows`` has doc_id, row (hash of the text) and root.

    The first has the least id, null ids last, then the least hash; of rows with equal id and
    text one is kept.  It is found on narrow rows; texts are shuffled only as far as the
    anti-join with the rows that go requires.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    counted = stored(rows.groupBy("root", "doc_id", "row").count())
    first = stored(counted.groupBy("root").agg(F.min(key).alias("first")))
    judged = counted.join(first, "root").select("doc_id", "row", "count", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row") == F.col("row"))).alias("kept"))
    judged = stored(judged.where("not kept or count > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "kept"))
    goes, repeated = judged.where("not kept"), judged.where("kept")
    same = lambda left, right: left["doc_id"].eqNullSafe(right["_id"]) & (row_hash(left) == right["_row"])
    kept = docs.join(goes, same(docs, goes), "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same(kept, repeated), "left_anti").unionByName(kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents of which no other of the same class comes first by id; columns as given."""
    prepare(docs.sparkSession)
    prints = stored(with_fingerprint(docs.select("doc_id", "text", row_hash(docs).alias("row")), keep=("doc_id", "row")))
    classes = fingerprint_classes(stored(prints.select("fp").distinct()), radius)
    return keep_first(docs, prints.join(classes, "fp").select("doc_id", "row", "root"))
