"""Corpus analytics: distributions, breakdowns, allocation, sampling, projection, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.session import stored

# Routing classes, speed classes and thresholds.
PREFLIGHT = ("FAST_TEXT_LIKELY", "SELECTIVE_OCR_CANDIDATE", "SCAN_OR_HEAVY_FALLBACK_RISK", "WIDER_DISCOVERY_NEEDED", "UNCERTAIN")
STRONG_TARGET_SCORE, MIN_TEXT_CHARACTERS = 70, 50


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-04: total, mean, median, nearest-rank 90th percentile and maximum, all exact."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").alias("p90"), F.max(v).alias("maximum"))


def percent(part: Column, whole: Column) -> Column:
    """AGG-05: percentage to two places, zero of nothing."""
    return F.when(whole > 0, F.round(100 * part / whole, 2)).otherwise(0.0)


def breakdown(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """AGG-06, AGG-07: measures overall, by each key and by all keys, by one pass over grouping sets."""
    sets = [[], *[[k] for k in keys], keys] if len(keys) > 1 else [[], keys]
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().alias("grouping"), *[c.alias(n) for n, c in measures.items()])


def zero_filled(counts: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """AGG-07: every bucket of the dimension, zero where nothing was counted."""
    return buckets.join(counts, key, "left").na.fill(0)


def largest_remainder(populations: DataFrame, total: int, key: str = "key", population: str = "population", minimum_one: bool = False) -> DataFrame:
    """TOP-05: floors of the ideals, what remains by the largest fractions, ties by key."""
    all_rows = Window.partitionBy()
    active = F.col(population) > 0
    n = F.sum(F.when(active, 1).otherwise(0)).over(all_rows)
    least = F.when(F.lit(minimum_one) & (F.lit(total) >= n) & active, 1).otherwise(0)
    based = populations.withColumn("_least", least).withColumn("_rest", F.lit(total) - F.sum("_least").over(all_rows)).withColumn("_all", F.sum(population).over(all_rows))
    # Whole numbers throughout: the ideal is population * rest / all, its fraction the remainder.
    product = F.col(population) * F.col("_rest")
    split = based.withColumn("_floor", F.when(F.col("_all") > 0, F.floor(product / F.col("_all"))).otherwise(0)).withColumn("_fraction", product - F.col("_floor") * F.col("_all"))
    open_seats = F.col("_rest") - F.sum("_floor").over(all_rows)
    rank = F.row_number().over(Window.orderBy((F.col(population) > 0).desc(), F.col("_fraction").desc(), F.col(key).cast("string")))
    seats = split.withColumn("_open", open_seats).withColumn("_rank", rank)
    return seats.withColumn("quota", F.when(active, F.col("_least") + F.col("_floor") + F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0)).otherwise(0).cast("long")).drop("_least", "_rest", "_all", "_floor", "_fraction", "_open", "_rank")


def nearest_allocation(populations: DataFrame, total: int, key: str = "key", population: str = "population", minimum_one: bool = False) -> DataFrame:
    """TOP-04: half-up rounding of the ideals (at least one), then corrected one seat a step where the
    quota is farthest from its ideal, ties by key.

    The corrections in closed form: the k-th seat that a key would gain or lose costs
    |ideal - quota| less k, so the steps are the first ranks of all keys' costs.
    """
    rows = Window.partitionBy()
    shares = populations.withColumn("_all", F.sum(population).over(rows)).withColumn("_ideal", F.col(population) * total / F.col("_all"))
    active = F.col(population) > 0
    n = F.sum(F.when(active, 1).otherwise(0)).over(rows)
    raised = F.lit(minimum_one) & (F.lit(total) >= n)
    rounded = shares.withColumn("_floor_one", F.when(raised, 1).otherwise(0)).withColumn("_quota", F.when(active, F.greatest(F.floor(F.col("_ideal") + 0.5), F.col("_floor_one"))).otherwise(0)).withColumn("_off", F.lit(total) - F.sum("_quota").over(rows))
    step = F.signum("_off").cast("int")
    steps = rounded.where(active & (F.col("_off") != 0)).select(key, population, "_ideal", "_quota", "_floor_one", "_off", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.greatest(F.abs("_off") - 1, F.lit(0)))).alias("_k"))
    moved = F.col("_quota") + F.col("_step") * (F.col("_k") + 1)
    legal = steps.where((moved <= F.col(population)) & (moved >= F.col("_floor_one")))
    cost = (F.col("_ideal") - F.col("_quota")) * F.col("_step") - F.col("_k")
    ranked = legal.withColumn("_rank", F.row_number().over(Window.orderBy(cost.desc(), F.col(key).cast("string"), "_k"))).where(F.col("_rank") <= F.abs("_off"))
    change = ranked.groupBy(key).agg(F.sum("_step").alias("_change"))
    return rounded.join(change, key, "left").withColumn("quota", (F.col("_quota") + F.coalesce("_change", F.lit(0))).cast("long")).drop("_all", "_ideal", "_floor_one", "_quota", "_off", "_change")


def seeded_sample(records: DataFrame, quotas: DataFrame, cell: list[str], path: str, seed: str) -> DataFrame:
    """TOP-06, JN-01: of each cell the first ``quota`` records by the hash of seed and path."""
    window = Window.partitionBy(*cell).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(path).cast("string")), 256))
    return records.join(quotas, cell).withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= F.col("quota")).drop("_rn")


def balanced_pilot(records: DataFrame, size: int, kind: str, province: str, path: str, kinds: tuple[str, str]) -> DataFrame:
    """TOP-03: half of each kind, provinces in turn by the hash of the path, leftovers by hash.

    Only the first ``size`` rows of a kind and province can count, which the engine keeps before it
    shuffles; the chosen ones are at most ``size`` rows, so they may be broadcast.
    """
    hashed = records.withColumn("_h", F.sha2(F.col(path).cast("string"), 256))
    rounds = hashed.select(kind, province, path, "_h", F.row_number().over(Window.partitionBy(kind, province).orderBy("_h")).alias("_round")).where(F.col("_round") <= size)
    chosen = None
    for name, quota in zip(kinds, (size // 2, size - size // 2), strict=True):
        part = rounds.where(F.col(kind) == name).orderBy("_round", province).limit(quota).select(F.col(path).alias("_path"))
        chosen = part if chosen is None else chosen.union(part)
    marked = hashed.join(F.broadcast(chosen.distinct()), F.col(path) == F.col("_path"), "left")
    return marked.orderBy(F.col("_path").isNull(), "_h").limit(size).drop("_h", "_path")


def numbered(records: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Each row's place in the order over all rows, from 0: positions in ranges of the order, and the
    sizes of the ranges before (a row for each range)."""
    placed = records.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def systematic(records: DataFrame, size: int, order: list[str]) -> DataFrame:
    """TOP-07: every k-th row of the order, k = rows // size (one at least), cut at size."""
    step = max(1, records.count() // size)
    ranked = numbered(records, order, "_rn")
    return ranked.where((F.pmod(F.col("_rn"), F.lit(step)) == 0) & (F.col("_rn") < step * size)).drop("_rn")


def projection(population: DataFrame, sample: DataFrame, cell: list[str], hit: Column) -> DataFrame:
    """AGG-12: estimate = rate of the cell times its population; unsampled cells are uncovered."""
    sizes = population.groupBy(*cell).agg(F.count("*").alias("population"))
    rates = sample.groupBy(*cell).agg(F.count("*").alias("sampled"), F.count_if(hit).alias("hits"))
    joined = sizes.join(rates, cell, "left")
    return joined.withColumn("covered", F.col("sampled").isNotNull()).withColumn("estimate", F.col("hits") / F.col("sampled") * F.col("population"))


def preflight_class(chars: Column, scanned: Column, text_pages: Column, pages: Column, candidates: Column, best: Column, licence: Column, project: Column) -> Column:
    """ORC-06: the routing class of a document's cheap signals; nulls count as zero or false."""
    z = lambda c: F.coalesce(c, F.lit(0))
    direct = (z(chars) > 0) & F.coalesce(licence, F.lit(False)) & F.coalesce(project, F.lit(False))
    weak = (z(chars) == 0) | (z(text_pages) == 0) | (F.when(z(scanned) > 0, z(chars) / z(scanned)).otherwise(0) < MIN_TEXT_CHARACTERS)
    return F.when(direct, PREFLIGHT[0]).when((z(candidates) > 0) & (z(best) >= STRONG_TARGET_SCORE), PREFLIGHT[1]).when(weak, PREFLIGHT[2]).when(z(scanned) < z(pages), PREFLIGHT[3]).otherwise(PREFLIGHT[4])


def speed_class(status: Column, polygons: Column, fallback: Column) -> Column:
    """ORC-08: a null fallback flag is ambiguous, not false."""
    return F.when((status == "HATA") | (F.coalesce(polygons, F.lit(0)) <= 0), "NO_USABLE_RESULT").when(fallback, "HEAVY_INLINE_USABLE").when(~fallback, "QUICK_USABLE").otherwise("AMBIGUOUS")


def unfinished(records: DataFrame, results: DataFrame, identity: list[str]) -> DataFrame:
    """ORC-07, JN-03: records without a result (resume)."""
    return records.join(results, identity, "left_anti")


def snapshot(points: DataFrame, keys: list[str], token: str, epsg: str, confidence: str, conflict: str) -> DataFrame:
    """AGG-08: counts, unique and strong tokens and a fingerprint of a document's geometry.

    Rows are counted by token first, so no distinct count has to expand them.
    """
    strong = F.coalesce(F.col(epsg).isNotNull() & (F.col(confidence) == "HIGH") & ~F.col(conflict), F.lit(False))
    each = points.groupBy(*keys, token).agg(F.count("*").alias("_n"), F.bool_or(strong).alias("_strong"))
    tokens = F.array_sort(F.collect_list(token))
    known = F.col(token).isNotNull()
    return each.groupBy(*keys).agg(F.sum("_n").alias("points"), F.count_if(known).alias("unique_tokens"), F.count_if(known & F.col("_strong")).alias("strong_tokens"), F.sha2(F.array_join(tokens, "\n"), 256).alias("fingerprint"), tokens.alias("tokens"))


def token_provenance(points: DataFrame, token: str, confidence: str, identity: str, conflict: str) -> DataFrame:
    """AGG-09: per token the sorted confidences and identities, and whether any conflicts."""
    return points.groupBy(token).agg(F.array_sort(F.collect_set(confidence)).alias("confidences"), F.array_sort(F.collect_set(identity)).alias("identities"), F.bool_or(conflict).alias("any_conflict"))


def snapshot_diff(primary: Column, refined: Column, primary_rings: Column, refined_rings: Column) -> Column:
    """SET-01: class of the change between two token sets and ring-fingerprint sets."""
    fresh, lost = F.size(F.array_except(refined, primary)), F.size(F.array_except(primary, refined))
    rings = F.size(F.array_except(refined_rings, primary_rings)) + F.size(F.array_except(primary_rings, refined_rings))
    return F.when(primary.isNull() | (F.size(primary) == 0), "PRIMARY_GEOMETRY_UNAVAILABLE").when((fresh == 0) & (lost == 0) & (rings == 0), "SAME_GEOMETRY").when((fresh == 0) & (lost == 0), "SEMANTIC_OR_REPEAT_ONLY").when((fresh > 0) & (lost == 0), "NEW_UNIQUE_GEOMETRY").otherwise("MIXED_OR_OTHER")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """AGG-15: occurrences of substrings."""
    return sum((F.regexp_count(text, F.lit(k)) for k in keywords), F.lit(0))


def best_attempt(attempts: DataFrame, doc: str = "doc_id", order: str = "attempt") -> DataFrame:
    """AGG-11, ORC-02, ORC-03: the attempt with most polygons, points, tables; the earliest of equals."""
    rank = Window.partitionBy(doc).orderBy(F.col("polygons").desc(), F.col("coordinates").desc(), F.col("tables").desc(), order)
    return attempts.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")


def completeness(rings: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG-11: COMPLETE with a licence and a CED or project ring, USEFUL_PARTIAL with any, else EMPTY."""
    kinds = rings.groupBy("doc_id").agg(F.bool_or(F.col("table_type") == "RUHSAT_ALANI").alias("_l"), F.bool_or(F.col("table_type").isin("CED_ALANI", "MEVCUT_CED_ALANI", "YENI_CED_ALANI", "PROJE_ALANI")).alias("_p"))
    state = F.when(F.col("_l") & F.col("_p"), "COMPLETE").when(F.col("_l").isNotNull(), "USEFUL_PARTIAL").otherwise("EMPTY")
    return documents.select("doc_id").join(kinds, "doc_id", "left").select("doc_id", state.alias("completeness"))
