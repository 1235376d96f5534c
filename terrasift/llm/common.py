"""Helpers shared by the operators of this subpackage.

Words are runs of characters outside ``\\x20 \\x09-\\x0D`` and lower-casing touches
A-Z only: on UTF-8 bytes these are exactly ``bytes.split()`` and ``bytes.lower()``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrasift.session import shared_dir, ship, stored  # stored: for the operators


# Arrays of a few hundred KB come and go in every loop of the workers.  By default each of
# them is mapped and unmapped, and the page faults cost ten times the arithmetic.
with contextlib.suppress(OSError, AttributeError):
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD

#: Separators of words, as a Java regex class.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 1_000_000
BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
BITS64 = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """The package on the executors, a folder for checkpoints, and batches of ``ROWS`` rows for the workers,
    unless the session has its own number: whole texts make large rows."""
    ship(spark)
    shared_dir(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(ROWS))


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query's shuffle files go at its end: what is used twice is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, or the first lengthening of it by underscores, that no column has in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def words_column(text: Column) -> Column:
    """The words of a text as an array (null text: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def as_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a binary column whose bytes stay under ``limit`` (one row may exceed it)."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or b""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def hash_words(words: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words, repeat(seed)), np.uint64, len(words))


def tokens(texts: list[bytes], drop: bytes = b"") -> tuple[list[bytes], np.ndarray]:
    """All lower-cased words of the texts in one list, and the number of words of each text."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text.lower().translate(None, drop) if drop else text.lower()).split()
        flat += words
        counts[i] = len(words)
    return flat, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit combination of word hashes over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs that start at each word but the last k - 1."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BITS64 + words[j : j + n]
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chained(df: DataFrame, by: list[str], group: str, links: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``links`` makes of each row and the row before it in the order of ``by``, within a ``group``.

    ``links`` gets two tables of as many rows, each row's predecessor and itself, and returns a
    table of the schema.  The order is dealt out by ranges, so a group of any size is spread over
    tasks; pairs over the border of two tasks are made from the tasks' first and last rows, of
    which there are no more than tasks.
    """
    names = df.columns
    out = [x.split()[0] for x in schema.split(", ")]

    def made(before: pa.Table, after: pa.Table) -> pa.Table:
        same = pc.equal(before.column(group), after.column(group))
        return links(before.filter(same), after.filter(same)).select(out)

    def run(batches):
        first = last = None
        empty = lambda table, width: [pa.nulls(table.num_rows, t) for t in width]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            whole = rows if last is None else pa.concat_tables([last, rows])
            first = rows.slice(0, 1) if first is None else first
            found = made(whole.slice(0, whole.num_rows - 1), whole.slice(1))
            last = rows.slice(rows.num_rows - 1, 1)
            if found.num_rows:
                yield from pa.table([*found.columns, *empty(found, [f.type for f in rows.schema])], names=[*out, *(f"_{c}" for c in names)]).to_batches()
        if first is not None:
            for edge in (first, last):
                yield from pa.table([*empty(edge, out_types), *edge.columns], names=[*out, *(f"_{c}" for c in names)]).to_batches()

    out_types = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema).types
    both = schema + ", " + ", ".join(f"`_{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ordered = df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by)
    found = stored(ordered.mapInArrow(run, both))
    edges = found.where(F.col(f"_{group}").isNotNull()).select(*[F.col(f"_{c}").alias(c) for c in names]).orderBy(*by).toArrow()
    over = made(edges.slice(0, max(0, edges.num_rows - 1)), edges.slice(1))
    return found.where(F.col(f"_{group}").isNull()).select(*out).union(df.sparkSession.createDataFrame(over.to_pylist(), schema))
