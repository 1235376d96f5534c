"""Mixing sources to target weights, by DataFrame functions alone.

Targets.  Sources take the given weights in the order of their names (code points, null
last), cyclically, and share ``share`` times all sizes; no target exceeds ``cap`` times
its source's size, and what that leaves is shared again by weight until none is above.
That is water-filling: with the sources in the order of cap / weight, the level is
(budget - caps below) / (weights not below), found by one window over the sources.

Sampling.  Efraimidis-Spirakis: a document's key is an exponential variable (from the MD5
of its id, so reruns agree) divided by its quality weight; within a source documents
follow in the order of their keys.  A target of e whole sizes and a rest takes every
document e times; the rest goes to the first documents in that order, by prefix sums of
sizes, the document at the budget's edge being taken in part.

Scale.  A source may hold a third of all rows, so its order is not made in one task: the
distribution of the keys (a mixture over the few levels of the weights) cuts each source
into equal buckets of about ``BUCKET`` rows.  Sums over buckets tell in which one the rest
ends; only that bucket's rows are ordered, which gives the source's cut: a key, and how
much of the document at it is taken.  Every row then compares its key with its source's
cut, so neither texts nor sources are shuffled.

The default quality weight is lexical diversity: the share of distinct words, in eighths.
Nulls, ties, repeats: a null text has size 0, a null id the key of the empty text; equal
keys are ordered by id and size; repeated rows are documents of their own and
share equally, in whole words, what the cut leaves for them.  An empty
table, or one whose sizes are all 0, takes nothing.  Other columns pass through; one named size,
source_size, target or taken is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import shared_dir as prepare_folder
from terrasift.llm.common import fresh, stored, words_column

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET = 5_000
LEVELS = 8


def diversity(words: Column) -> Column:
    """Level 1 to LEVELS of the share of distinct words; 1 for a text without words."""
    share = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.greatest(F.ceil(share * LEVELS), F.lit(1)).cast("int")


def exponential(doc_id: Column, seed: str = "") -> Column:
    """A standard exponential variable that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52))


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """Adds ``target`` (double) to a table with a row for each source and its ``source_size``."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")))
    limited = weighed.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(share) * total - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum("w").over(rest)
    levels = limited.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    water = F.min(F.when(F.col("fits"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(water * F.col("w"), F.col("limit").cast("double")))).drop("w", "limit", "ratio", "level", "fits")


def cuts(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """One row a source: its size, target, whole epochs and cut, from (source, doc_id, size, level, key)."""
    counts = [F.count_if(F.col("level") == k).alias(f"_n{k}") for k in range(1, LEVELS + 1)]
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"), *counts)
    plan = targets(per_source, weights, cap, share).withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    plan = stored(plan.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source"))
    # The share of the source's keys up to this one is uniform over its documents.
    mass = sum((F.col(f"_n{k}") * (1 - F.exp(-F.col("key") * (k / LEVELS))) for k in range(1, LEVELS + 1)), F.lit(0.0)) / F.col("_n")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", F.floor(mass * F.ceil(F.col("_n") / BUCKET)).cast("long")).select("_source", "rest", "bucket", "doc_id", "size", "key")
    sums = placed.groupBy("_source", "rest", "bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_before <= rest and rest < _before + _sum").select(F.col("_source").alias("_es"), F.col("bucket").alias("_eb"), (F.col("rest") - F.col("_before")).alias("_room"))
    inside = placed.join(edge, F.col("_source").eqNullSafe(F.col("_es")) & (F.col("bucket") == F.col("_eb"))).groupBy("_source", "_room", "key", "doc_id", "size").count()
    ahead = Window.partitionBy("_source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = inside.withColumn("_ahead", F.coalesce(F.sum(F.col("size") * F.col("count")).over(ahead), F.lit(0))).where("_ahead <= _room and _room < _ahead + size * count")
    cut = ordered.select(F.col("_source").alias("_cs"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.expr("(_room - _ahead) div count").alias("cut_part"))
    return stored(plan.select("_source", "source_size", "target", "epochs").join(cut, F.col("_source").eqNullSafe(F.col("_cs")), "left").drop("_cs"))


def mix(docs: DataFrame, size: Column, level: Column, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: str = "") -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken (words, repeats counted).

    ``level`` is the quality weight in LEVELS-ths, a whole number from 1 to LEVELS.
    """
    prepare_folder(docs.sparkSession)
    key = exponential(F.col("doc_id"), seed) * LEVELS / level
    found = cuts(stored(docs.select("source", "doc_id", size.cast("long").alias("size"), level.cast("int").alias("level"), key.alias("key"))), weights, cap, share)
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col("source").alias("_s"), F.col("doc_id").alias("_id"), size.cast("long").alias("_size"), key.alias("_key"))
    joined = rows.join(found, F.col("_s").eqNullSafe(F.col("_source")))
    same = F.col("_key") == F.col("cut_key")
    first = same & ((F.col("_id") < F.col("cut_id")) | (F.col("_id").isNotNull() & F.col("cut_id").isNull()) | (F.col("_id").eqNullSafe(F.col("cut_id")) & (F.col("_size") < F.col("cut_size"))))
    at = same & F.col("_id").eqNullSafe(F.col("cut_id")) & (F.col("_size") == F.col("cut_size"))
    part = F.when((F.col("_key") < F.col("cut_key")) | first, F.col("_size")).when(at, F.col("cut_part")).otherwise(0)
    added = ("size", "source_size", "target", "taken")
    out = joined.withColumn("taken", (F.col("epochs") * F.col("_size") + part).cast("long"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own) if c.lower() not in added], F.col("_size").alias("size"), "source_size", "target", "taken")


def measured(docs: DataFrame, *keep: str) -> tuple[DataFrame, Column, Column]:
    """The kept columns beside two more, and these: size (words) and diversity of the whole text."""
    held, size, level = (fresh(docs.columns, c) for c in ("_words", "_size", "_level"))
    kept = [F.col(f"`{c}`") for c in keep]
    words = docs.select(*kept, words_column(docs["text"]).alias(held))
    return words.select(*kept, F.size(held).cast("long").alias(size), diversity(F.col(held)).alias(level)), F.col(size), F.col(level)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    rows, size, level = measured(docs, "doc_id", "source")
    return mix(stored(rows), size, level).select("doc_id", "size", "source_size", "target", "taken")


#: The same by plain windows, for an engine that orders each source at once.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
k AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size,
    greatest(ceil(len(list_distinct(ws)) / greatest(len(ws), 1)::DOUBLE * 8), 1) AS lv,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS e FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, 3 * source_size / w AS ratio, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (total::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT level AS water FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT water FROM v) * w, lim::DOUBLE)) AS target FROM l),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY e * 8 / lv, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM o
"""
