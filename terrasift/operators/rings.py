"""Rings: grouping, areas, repair, identities, duplicates.

Relational parts are Column expressions over ``points array<struct<seq,name,y,x,lat,lon>>``;
order-dependent repair runs over batches of rings in ``mapInPandas``, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import geometry
from terrasift.functions.numbers import bound
from terrasift.operators.points import crs_aggregates
from terrasift.session import ship

VERTEX = "struct<seq:int,name:string,y:double,x:double,lat:double,lon:double>"
KEYS = ["doc_id", "table_type", "section", "table_index", "polygon_group"]
PIN_LIMIT_M2 = 5000.0


def grouped(points: DataFrame) -> DataFrame:
    """AGG-02: one row per (document, type, section, table, group), vertices in order."""
    vertex = F.struct(F.col("seq").cast("int").alias("seq"), F.col("label").alias("name"), F.coalesce("utm_y", "longitude").alias("y"), F.coalesce("utm_x", "latitude").alias("x"), F.coalesce("transformed_latitude", "latitude").alias("lat"), F.coalesce("transformed_longitude", "longitude").alias("lon"))
    first = lambda c: F.first_value(c, ignoreNulls=F.lit(True)).alias(c)
    sectioned = points if "section" in points.columns else points.withColumn("section", F.coalesce("heading", F.lit("")))
    return sectioned.groupBy(*KEYS).agg(F.array_sort(F.collect_list(vertex)).alias("points"), F.min("seq").alias("first_seq"), *[first(c) for c in ("polygon_heading", "declared_ha", "projected_crs_epsg")], *crs_aggregates())


def double_area(points: Column) -> Column:
    """Twice the signed shoelace sum of y and x, closed implicitly."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.try_element_at(points, i)["y"] * F.try_element_at(points, i % F.size(points) + 1)["x"] - F.try_element_at(points, i % F.size(points) + 1)["y"] * F.try_element_at(points, i)["x"],
    )


def area_m2(points: Column) -> Column:
    """AGG-03: metre shoelace; rings in degrees by the equirectangular plane at their mean latitude."""
    n = F.size(points)
    degrees = F.forall(points, lambda p: (F.abs(p["y"]) <= 180) & (F.abs(p["x"]) <= 180))
    mean = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"]) / n
    scale = F.when(degrees, 111320.0 * 111320.0 * F.cos(F.radians(mean))).otherwise(1.0)
    return F.when(n >= 3, F.abs(double_area(points)) / 2 * scale).otherwise(0.0)


def is_closed(points: Column) -> Column:
    """GEO-09."""
    a, b = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return F.coalesce((F.size(points) > 1) & (a["y"] == b["y"]) & (a["x"] == b["x"]), F.lit(False))


def fixed(value: Column, places: str) -> Column:
    """A number as text in a fixed pattern."""
    return F.call_function("format_number", value, F.lit(places))


def geometry_key(points: Column) -> Column:
    """GEO-10: sorted distinct rounded vertices: blind to order, direction and topology."""
    places = lambda v: F.when(F.abs(v) <= 180, fixed(v, "0.000000")).otherwise(fixed(v, "0.000"))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(points, lambda p: F.concat_ws(",", places(p["y"]), places(p["x"]))))), ";")


def canonical(tokens: Column) -> Column:
    """GEO-11: least rotation over both directions of an array, its closing element removed.

    It begins with a least element, so only rotations from these are compared, two at a time.  Arrays are bound
    by a transform over one element: a lambda would compute them anew wherever it names them.
    """
    def least(ring: Column) -> Column:
        n = F.size(ring)

        def turned(r: Column, first: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(r, i).eqNullSafe(first))
            return F.aggregate(starts, F.lit(None).cast("array<string>"), lambda best, i: F.least(best, F.concat(F.slice(r, i, n), F.slice(r, 1, i - 1))))

        both = lambda first: F.least(turned(ring, first), bound(F.reverse(ring), lambda r: turned(r, first)))
        return F.when(n <= 0, ring).otherwise(bound(F.element_at(F.sort_array(ring), 1), both))

    def opened(all_: Column) -> Column:
        closed = (F.size(all_) > 1) & (F.try_element_at(all_, F.lit(1)) == F.try_element_at(all_, F.lit(-1)))
        return F.when(closed, F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)

    return bound(bound(tokens, opened), least)


def crossing_pairs(edges: DataFrame, ring: str = "ring_id", index: str = "i", count: str = "n") -> DataFrame:
    """JN-08, GEO-02: pairs of crossing edges (ring, i, y1, x1, y2, x2, n) by a self-join within rings."""
    a, b = edges.alias("a"), edges.alias("b")
    c = lambda s, f: F.col(f"{s}.{f}")

    def turn(p, q, r):
        return F.signum((q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1]))

    p1, p2, p3, p4 = ((c("a", "y1"), c("a", "x1")), (c("a", "y2"), c("a", "x2")), (c("b", "y1"), c("b", "x1")), (c("b", "y2"), c("b", "x2")))
    shared = F.lit(False)
    for p in (p1, p2):
        for q in (p3, p4):
            shared = shared | ((p[0] == q[0]) & (p[1] == q[1]))
    apart = (c("a", ring) == c("b", ring)) & (c("a", index) + 1 < c("b", index)) & ~((c("a", index) == 0) & (c("b", index) == c("b", count) - 1))
    o = [turn(p1, p2, p3), turn(p1, p2, p4), turn(p3, p4, p1), turn(p3, p4, p2)]
    proper = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    return a.join(b, apart & ~shared & proper).select(c("a", ring).alias(ring), c("a", index).alias("i"), c("b", index).alias("j"))


def as_array(points) -> np.ndarray:
    rows = [(p["y"], p["x"], p["lat"], p["lon"]) for p in (points if points is not None else ())]
    return np.array([[np.nan if v is None else v for v in r] for r in rows], np.float64).reshape(-1, 4)


def vertex_arrays(points: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of a batch's rings, the (y, x, lat, lon) of all vertices (null: NaN), and their names."""
    offsets = np.concatenate(([0], np.cumsum(np.nan_to_num(np.asarray(points.value_lengths().fill_null(0)))))).astype(np.int64)
    flat = points.flatten()
    values = np.stack([np.asarray(flat.field(f).cast(pa.float64()).fill_null(np.nan)) for f in ("y", "x", "lat", "lon")], axis=1) if len(flat) else np.zeros((0, 4))
    return offsets, values, flat.field("name")


def by_ring(rings: DataFrame, schema: str, measure) -> DataFrame:
    """A row per ring: its first column and what ``measure`` says of its (y, x).  Only these go to Python, as flat
    arrays of a batch, not as an object a vertex."""
    ship(rings.sparkSession)
    key = rings.columns[0]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ends = np.concatenate(([0], np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0))))).astype(np.int64)
                values = np.stack([np.asarray(batch.column(c).flatten().fill_null(np.nan)) for c in (1, 2)], axis=1)
                said = [measure(values[start:stop]) for start, stop in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*said, strict=True))], names=names)

    places = rings.select(key, *[F.transform("points", lambda p: p[c].cast("double")).alias(c) for c in ("y", "x")])  # noqa: B023
    names = [key, *(part.split()[0] for part in schema.split(","))]
    return places.mapInArrow(run, f"{key} {dict(rings.dtypes)[key]}, {schema}")


def repaired(rings: DataFrame) -> DataFrame:
    """GEO-04..08: lattice trimmed, crossings repaired; a row per part (part_no), others as given.

    Vertices without a position are left out; a vertex that a repair makes is named X.
    """
    ship(rings.sparkSession)
    fields = [c for c in rings.columns if c != "points"]
    schema = rings.select(*fields, F.lit(0).alias("part_no"), F.lit(0).alias("crossings_before"), F.col("points").cast(f"array<{VERTEX}>")).schema

    def parts_of(given: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
        trimmed = [geometry.trim_lattice(ring) for ring in given]
        found = geometry.repair_all(trimmed)
        return [f if len(t) == len(ring) else (geometry.count_crossings(ring), f[1]) for ring, t, f in zip(given, trimmed, found, strict=True)]

    def run(batches):
        for batch in batches:
            offsets, values, names = vertex_arrays(batch.column(len(fields)))
            rows, numbers, before, sizes, where, out = [], [], [], [], [], [np.zeros((0, 4))]
            placed = ~np.isnan(values[:, :2]).any(1)
            held = [np.arange(*ends)[placed[slice(*ends)]] for ends in zip(offsets[:-1], offsets[1:], strict=True)]
            for i, (at, (crossed, parts)) in enumerate(zip(held, parts_of([values[at] for at in held]), strict=True)):
                known = None
                for k, part in enumerate(parts):
                    if not len(part):
                        continue
                    if part.shape == (len(at), 4) and np.array_equal(part, values[at], equal_nan=True):
                        where.append(at)
                    else:
                        known = known or {tuple(v): j for v, j in zip(values[at, :2], at, strict=True)}
                        where.append(np.array([known.get(tuple(v), -1) for v in part[:, :2]]))
                        part = np.hstack([part, np.full((len(part), 4 - part.shape[1]), np.nan)])
                    rows.append(i)
                    numbers.append(k)
                    before.append(crossed)
                    sizes.append(len(part))
                    out.append(part)
            flat, index = np.concatenate(out), np.concatenate([np.zeros(0, np.int64), *where])
            named = names.take(pa.array(np.where(index < 0, 0, index), mask=index < 0)).cast(pa.string()) if len(names) else pa.nulls(len(index), pa.string())
            seq = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
            cells = [pa.array(seq, pa.int32()), pa.compute.if_else(pa.array(index < 0), "X", named), *(pa.array(flat[:, j], from_pandas=True) for j in range(4))]
            points = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(cells, ["seq", "name", "y", "x", "lat", "lon"]))
            kept = batch.select(range(len(fields))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int32()), pa.array(before, pa.int32()), points], names=schema.names)

    return rings.select(*fields, "points").mapInArrow(run, schema)


def without_subsets(rings: DataFrame) -> DataFrame:
    """SET-03: drop a ring whose vertices are a strict subset of another's of its document and type,
    and the later ones of rings with the same vertices.

    Candidates meet on their least vertex being a vertex of the other: an equi-join, no square.
    """
    tokens = F.array_sort(F.array_distinct(F.transform("points", lambda p: F.concat_ws(",", fixed(p["y"], "0.000"), fixed(p["x"], "0.000")))))
    keyed = rings.withColumn("_t", tokens).withColumn("_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS], F.col("part_no").cast("string")))
    small = keyed.select(F.col("doc_id").alias("_d"), F.col("table_type").alias("_k"), F.try_element_at("_t", F.lit(1)).alias("_v"), F.col("_t").alias("_ts"), F.col("_id").alias("_small"), F.col("first_seq").alias("_fs"))
    big = keyed.select(F.col("doc_id").alias("_d"), F.col("table_type").alias("_k"), F.explode("_t").alias("_v"), F.col("_t").alias("_tb"), F.col("_id").alias("_big"), F.col("first_seq").alias("_fb"))
    inside = (F.size(F.array_except("_ts", "_tb")) == 0) & (F.col("_small") != F.col("_big"))
    strict = F.size("_tb") > F.size("_ts")
    same = (F.size("_tb") == F.size("_ts")) & ((F.col("_fb") < F.col("_fs")) | ((F.col("_fb") == F.col("_fs")) & (F.col("_big") < F.col("_small"))))
    gone = small.join(big, ["_d", "_k", "_v"]).where(inside & (strict | same)).select(F.col("_small").alias("_id")).distinct()
    return keyed.join(gone, "_id", "left_anti").drop("_id", "_t")


def build(points: DataFrame) -> DataFrame:
    """Rings of a point table, repaired, with area, closure and pin rule (GEO-14)."""
    rings = without_subsets(repaired(grouped(points)))
    area = F.round(area_m2(F.col("points")), 2)
    pin = (F.size("points") < 3) | ((F.col("table_type") == "GALERI_ALANI") & (area > PIN_LIMIT_M2))
    out = rings.withColumn("area_m2", area).withColumn("area_ha", F.round(area_m2(F.col("points")) / 10000, 4)).withColumn("point_count", F.size("points")).withColumn("is_closed", is_closed(F.col("points")))
    return out.withColumn("geometry_type", F.when(pin, "POINT").otherwise("POLYGON"))


def lonlat_parts(rings: DataFrame) -> DataFrame:
    """GEO-12, SNK-03: the KML coordinate text of each ring's parts in degrees, none of them crossing."""
    ship(rings.sparkSession)
    fields = [c for c in rings.columns if c != "points"]
    schema = rings.select(*fields, F.lit(0).alias("kml_part"), F.lit("").alias("coordinates"), F.lit(0).alias("crossings")).schema

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                ring = as_array(row["points"])[:, [3, 2]]
                if len(ring) < 3 or np.isnan(ring).any():
                    continue
                for k, part in enumerate(geometry.repair_lonlat(ring)):
                    shut = part if (part[0] == part[-1]).all() else np.vstack([part, part[:1]])
                    out.append({**{f: row[f] for f in fields}, "kml_part": k, "coordinates": " ".join(f"{a:.9f},{b:.9f},0" for a, b in shut), "crossings": geometry.count_crossings(part, geometry.DEGREE_TOLERANCE)})
            yield pd.DataFrame(out, columns=schema.names)

    return rings.select(*fields, "points").mapInPandas(run, schema)


def ordered_edges(vertices: DataFrame, ring: str, order: list[str]) -> DataFrame:
    """Edges (i, n, y1, x1, y2, x2) of vertex rows (ring, y, x) in the given order, the last to the first."""
    window = Window.partitionBy(ring).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        ring,
        (F.row_number().over(window) - 1).alias("i"),
        F.count("*").over(Window.partitionBy(ring)).alias("n"),
        F.col("y").alias("y1"),
        F.col("x").alias("x1"),
        F.coalesce(F.lead("y").over(window), F.first_value("y").over(whole)).alias("y2"),
        F.coalesce(F.lead("x").over(window), F.first_value("x").over(whole)).alias("x2"),
    )
