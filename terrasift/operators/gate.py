"""The fail-closed quality gate: area, CRS, layer and duplicate rules, verdict, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions.labels import is_label
from terrasift.functions.numbers import is_easting, is_northing, number_tokens
from terrasift.functions.text import fold
from terrasift.operators.classify import AREA_TYPES, CED, LICENCE
from terrasift.operators.rings import geometry_key

# Tolerances, ranges, codes and province centroids (longitude, latitude).
RELATIVE, FLOOR_HA, LARGEST_HA = 0.15, 0.10, 5000.0
LON_RANGE, LAT_RANGE = (25.0, 45.5), (35.5, 42.5)
PROVINCE_LON, PROVINCE_LAT = 2.5, 1.8
REASON_CODES = (
    "NO_COORDINATE_TABLE", "DETECTED_TABLE_NO_POINTS", "POINTS_NO_POLYGON", "GROUP_BELOW_POLYGON_SIZE", "CRS_INHERITED",
    "CRS_UNRESOLVED_NO_TRANSFORM", "KML_NO_WGS84", "KML_RING_STILL_CROSSED", "AREA_MISMATCH", "CRS_AREA_INSANE",
    "CRS_LONLAT_OUT_OF_RANGE", "MISSING_RUHSAT_OR_CED", "DUPLICATE_LAYER_GEOMETRY", "EXPORT_BLOCKED",
)
PROVINCES = {
    "ADANA": (35.32, 37.00), "ADIYAMAN": (38.28, 37.76), "AFYON": (30.54, 38.76), "AFYONKARAHISAR": (30.54, 38.76),
    "ANKARA": (32.85, 39.93), "ANTALYA": (30.71, 36.90), "ARTVIN": (41.82, 41.18), "AYDIN": (27.84, 37.84),
    "BALIKESIR": (27.89, 39.65), "BILECIK": (29.98, 40.14), "BOLU": (31.61, 40.74), "BURDUR": (30.29, 37.72),
    "CANAKKALE": (26.41, 40.16), "CORUM": (34.95, 40.55), "DENIZLI": (29.09, 37.77), "DIYARBAKIR": (40.23, 37.91),
    "ELAZIG": (39.23, 38.67), "ERZINCAN": (39.49, 39.75), "ERZURUM": (41.27, 39.91), "ESKISEHIR": (30.52, 39.78),
    "GAZIANTEP": (37.38, 37.07), "GIRESUN": (38.39, 40.91), "GUMUSHANE": (39.48, 40.46), "HATAY": (36.16, 36.20),
    "ICEL": (34.64, 36.81), "KASTAMONU": (33.78, 41.38), "KAYSERI": (35.49, 38.73), "KIRKLARELI": (27.23, 41.74),
    "KOCAELI": (29.92, 40.77), "KONYA": (32.49, 37.87), "KUTAHYA": (29.98, 39.42), "MALATYA": (38.31, 38.35),
    "MANISA": (27.43, 38.61), "KAHRAMANMARAS": (36.94, 37.59), "MARAS": (36.94, 37.59), "MERSIN": (34.64, 36.81),
    "MUGLA": (28.37, 37.22), "NIGDE": (34.68, 37.97), "ORDU": (37.88, 40.98), "RIZE": (40.52, 41.02),
    "SAKARYA": (30.40, 40.76), "SAMSUN": (36.33, 41.29), "SIIRT": (41.95, 37.93), "SIVAS": (37.02, 39.75),
    "TRABZON": (39.72, 41.00), "TUNCELI": (39.54, 39.11), "VAN": (43.38, 38.50), "YOZGAT": (34.80, 39.82),
    "ZONGULDAK": (31.79, 41.46),
}
#: Words that may stand between the two names of a combined layer: before the conjunction, and after it.
BEFORE_JOIN, AFTER_JOIN = 8, 4


def compare_area(declared: Column, computed: Column, relative: float = RELATIVE, floor: float = FLOOR_HA) -> Column:
    """QA-01: struct of delta, allowed, ratio (rounded to 4) and match; null without a positive declaration."""
    delta = F.abs(computed - declared)
    allowed = F.greatest(relative * declared, F.lit(floor))
    record = F.struct(F.round(delta, 4).alias("delta_ha"), F.round(allowed, 4).alias("allowed_ha"), F.round(computed / declared, 4).alias("ratio"), (delta <= allowed).alias("match"))
    return F.when((declared > 0) & computed.isNotNull(), record)


def is_combined(heading: Column) -> Column:
    """Whether a heading names the licence and the project's area with a conjunction between them.

    Words become letters: L and P for the two names, J for a conjunction, - for the rest.
    """
    words = F.split(F.regexp_replace(F.regexp_replace(fold(heading), r"PROJE\s+ALAN", "CED"), "[&/,]", " VE "), "[^A-Z0-9]+")
    letter = lambda w: F.when(w.startswith("RUHSAT"), "L").when(w.startswith("CED"), "P").when(w == "VE", "J").otherwise("-")
    line = F.array_join(F.transform(F.filter(words, lambda w: w != ""), letter), "")
    gap = f"[-J]{{0,{BEFORE_JOIN}}}J-{{0,{AFTER_JOIN}}}"
    return F.coalesce(line.rlike(f"L{gap}P|P{gap}L"), F.lit(False))


def sanity_code(area_ha: Column, declared: Column, lon: Column, lat: Column) -> Column:
    """QA-02: a huge undeclared area, or a centroid outside the range, whose code wins if both hold."""
    justified = F.coalesce(area_ha <= F.greatest(F.lit(LARGEST_HA), declared * (1 + RELATIVE), declared + FLOOR_HA), F.lit(False))
    outside = F.coalesce(~lon.between(*LON_RANGE) | ~lat.between(*LAT_RANGE), F.lit(False))
    return F.when(outside, "CRS_LONLAT_OUT_OF_RANGE").when((area_ha > LARGEST_HA) & ~justified, "CRS_AREA_INSANE")


def centroids(spark: SparkSession) -> DataFrame:
    """The fixed table of centroids, a few dozen rows."""
    return spark.createDataFrame([(k, *v) for k, v in PROVINCES.items()], "province_key string, province_lon double, province_lat double")


def implausible(lon: Column, lat: Column, province_lon: Column, province_lat: Column) -> Column:
    """QA-05: far from the province; a legal longitude near the province's passes whatever the latitude."""
    near = F.abs(lon - province_lon) <= PROVINCE_LON
    return F.coalesce(~(near & ((F.abs(lat - province_lat) <= PROVINCE_LAT) | lon.between(*LON_RANGE))), F.lit(False))


def annotated(rings: DataFrame) -> DataFrame:
    """QA-01..03 on each ring."""
    mean = lambda f: F.aggregate(F.filter(F.transform("points", lambda p: p[f]), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(F.filter(F.transform("points", lambda p: p[f]), lambda v: v.isNotNull())), F.lit(0))
    area = F.col("geometry_type") != "POINT"
    out = rings.withColumn("lon", mean("lon")).withColumn("lat", mean("lat")).withColumn("comparison", F.when(area, compare_area(F.col("declared_ha"), F.col("area_ha"))))
    out = out.withColumn("sanity", F.when(area, sanity_code(F.col("area_ha"), F.col("declared_ha"), F.col("lon"), F.col("lat")))).withColumn("combined", is_combined(F.col("polygon_heading")) | is_combined(F.col("section")))
    same = Window.partitionBy("doc_id", "_key")
    keyed = out.withColumn("_key", F.when(area, geometry_key(F.col("points"))).otherwise(F.concat_ws("|", "table_type", "polygon_group", F.col("table_index").cast("string"))))
    typed = F.max(F.when(area & (F.col("table_type") != "DIGER"), 1)).over(same).isNotNull()
    out = keyed.withColumn("suppressed", area & (F.col("table_type") == "DIGER") & typed)
    both = F.max(F.when(area & F.col("table_type").isin(*LICENCE), 1)).over(same).isNotNull() & F.max(F.when(area & F.col("table_type").isin(*CED), 1)).over(same).isNotNull()
    return out.withColumn("silent_duplicate", area & F.col("table_type").isin(*LICENCE, *CED) & both & ~F.max("combined").over(same)).drop("_key")


def reasons(rings: DataFrame, documents: DataFrame) -> DataFrame:
    """QA-02..05: (doc_id, code, table_title, table_type) of everything that blocks a document.

    ``documents`` has doc_id and province for every document, so one without rings is blocked too.
    """
    shown = rings.where((F.col("geometry_type") != "POINT") & ~F.col("suppressed"))
    title = F.coalesce(F.nullif("polygon_heading", F.lit("")), F.nullif("section", F.lit("")), "table_type").alias("table_title")
    row = lambda df, code: df.select("doc_id", code.alias("code"), title, "table_type")
    area = row(shown.where(~F.col("comparison.match")), F.lit("AREA_MISMATCH"))
    sane = row(shown.where(F.col("sanity").isNotNull()), F.col("sanity"))
    placed = shown.join(documents.select("doc_id", F.replace(fold(F.col("province")), F.lit(" "), F.lit("")).alias("province_key")), "doc_id").join(centroids(rings.sparkSession), "province_key")
    far = row(placed.where(F.col("sanity").isNull() & F.col("lon").isNotNull() & implausible(F.col("lon"), F.col("lat"), F.col("province_lon"), F.col("province_lat"))), F.lit("CRS_LONLAT_OUT_OF_RANGE"))
    has = lambda kinds: F.coalesce(F.bool_or(F.col("table_type").isin(*kinds) | F.col("combined")), F.lit(False))
    layers = documents.select("doc_id").join(shown.groupBy("doc_id").agg(has(LICENCE).alias("_l"), has(CED).alias("_c"), F.bool_or("silent_duplicate").alias("_d")), "doc_id", "left")
    blank = [F.lit("").alias("table_title"), F.lit("").alias("table_type")]
    missing = layers.where(~F.coalesce(F.col("_l") & F.col("_c"), F.lit(False))).select("doc_id", F.lit("MISSING_RUHSAT_OR_CED").alias("code"), *blank)
    double = layers.where("_d").select("doc_id", F.lit("DUPLICATE_LAYER_GEOMETRY").alias("code"), *blank)
    return area.unionByName(sane).unionByName(far).unionByName(missing).unionByName(double)


def verdicts(found: DataFrame, documents: DataFrame) -> DataFrame:
    """QA-06: ok and the distinct codes of each document, EXPORT_BLOCKED among them if any."""
    order = F.array(*[F.lit(c) for c in REASON_CODES])
    codes = found.groupBy("doc_id").agg(F.collect_set("code").alias("_codes"))
    joined = documents.select("doc_id").join(codes, "doc_id", "left")
    listed = F.when(F.col("_codes").isNull(), F.array().cast("array<string>")).otherwise(F.filter(order, lambda c: F.array_contains("_codes", c) | (c == "EXPORT_BLOCKED")))
    return joined.select("doc_id", F.col("_codes").isNull().alias("ok"), listed.alias("codes"))


def exportable(rings: DataFrame, gate: DataFrame) -> DataFrame:
    """Rings of documents that pass, less what is suppressed: a semi-join before any write."""
    return rings.where(~F.col("suppressed")).join(gate.where("ok"), "doc_id", "left_semi")


def diagnostics(documents: DataFrame, tables: DataFrame, points: DataFrame, rings: DataFrame) -> DataFrame:
    """QA-07: (doc_id, code, severity, stage, table_index, polygon_group, point_count) of the stages' gaps."""
    blank = {"table_index": F.lit(None).cast("int"), "polygon_group": F.lit(None).cast("string"), "point_count": F.lit(None).cast("long")}

    def row(df, code, severity, stage, **more):
        cells = blank | more
        return df.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"), *[c.alias(k) for k, c in cells.items()])

    none = row(documents.join(tables, "doc_id", "left_anti"), "NO_COORDINATE_TABLE", "info", "detector")
    empty = row(tables.join(points, ["doc_id", "table_index"], "left_anti"), "DETECTED_TABLE_NO_POINTS", "error", "parser", table_index=F.col("table_index"))
    flat = points.groupBy("doc_id").agg(F.count("*").alias("_n")).join(rings, "doc_id", "left_anti")
    unringed = row(flat, "POINTS_NO_POLYGON", "error", "polygon_builder", point_count=F.col("_n"))
    small = points.groupBy("doc_id", "table_index", "polygon_group").agg(F.count("*").alias("_n")).where("_n < 3")
    below = row(small, "GROUP_BELOW_POLYGON_SIZE", "warning", "polygon_builder", table_index=F.col("table_index"), polygon_group=F.col("polygon_group"), point_count=F.col("_n"))
    crs = points.where("utm_y is not null").groupBy("doc_id", "table_index").agg(F.count("*").alias("_n"), F.bool_or(F.col("crs_source") == "INHERITED").alias("_i"), F.bool_or(F.col("projected_crs_epsg").isNull()).alias("_u"))
    carried = row(crs.where("_i"), "CRS_INHERITED", "info", "crs", table_index=F.col("table_index"), point_count=F.col("_n"))
    unresolved = row(crs.where("_u"), "CRS_UNRESOLVED_NO_TRANSFORM", "error", "crs", table_index=F.col("table_index"), point_count=F.col("_n"))
    out = none
    for part in (empty, unringed, below, carried, unresolved):
        out = out.unionByName(part)
    return out


def merged(*groups: DataFrame) -> DataFrame:
    """SET-04: union of diagnostics, the first of each (document, code, table, group)."""
    out = None
    for k, g in enumerate(groups):
        g = g.withColumn("_k", F.lit(k))
        out = g if out is None else out.unionByName(g)
    window = Window.partitionBy("doc_id", "code", "table_index", "polygon_group").orderBy("_k", "severity", "stage")
    return out.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn", "_k")


def as_text(found: DataFrame) -> DataFrame:
    """QA-08: one line of text for each diagnostic."""
    parts = F.concat_ws(" ", F.concat(F.lit("["), F.upper("severity"), F.lit("]")), "code", F.concat(F.lit("table="), F.col("table_index").cast("string")), F.concat(F.lit("group="), "polygon_group"), F.concat(F.lit("points="), F.col("point_count").cast("string")))
    return found.select("doc_id", parts.alias("line"))


def failure_report(tables: DataFrame, points: DataFrame) -> DataFrame:
    """QA-10: what each table's text offers to the parsers beside what they read, and why nothing came of it.

    Columns: lines, labels, numbers, eastings, northings, degrees, points, methods, finding.
    """
    rows = F.split("text", r"\r?\n")
    values = F.flatten(F.transform(rows, number_tokens))
    count = lambda test: F.size(F.filter("_values", test))
    seen = tables.select("doc_id", "table_index", F.size(F.filter(rows, lambda x: F.trim(x) != "")).alias("lines"), F.size(F.filter(rows, lambda x: is_label(F.trim(x)))).alias("labels"), values.alias("_values"))
    seen = seen.select("doc_id", "table_index", "lines", "labels", F.size("_values").alias("numbers"), count(is_easting).alias("eastings"), count(is_northing).alias("northings"), count(lambda v: v.between(25, 46) & (v != F.floor(v))).alias("degrees"))
    read = points.groupBy("doc_id", "table_index").agg(F.count("*").alias("points"), F.array_sort(F.collect_set("parser_method")).alias("methods"))
    out = seen.join(read, ["doc_id", "table_index"], "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long"))).withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    pairs = F.least("eastings", "northings")
    finding = F.when(F.col("points") >= 3, "OK").when(F.col("numbers") == 0, "NO_NUMBERS").when((pairs == 0) & (F.col("degrees") == 0), "NO_COORDINATE_RANGE").when(F.col("points") > 0, "TOO_FEW_POINTS").when(F.col("eastings") != F.col("northings"), "UNPAIRED_NUMBERS").otherwise("LAYOUT_NOT_READ")
    return out.withColumn("finding", finding)


#: QA-09: layout classes and the operators that own them.
LAYOUT_CLASSES = {
    "table_continuation": "documents.find_tables, classify.inherited",
    "coordinate_record_layouts": "numbers, documents.*_records",
    "detector_parser_contract": "gate.diagnostics",
    "crs_inheritance": "points.table_crs",
    "ring_geometry": "geometry, rings.repaired, rings.lonlat_parts",
    "grouping_typing": "documents.parse_table, rings.grouped",
    "table_vs_polygon_area_qa": "numbers.declared_hectares, gate",
    "metadata_kml_naming": "metadata, sinks",
    "coordinate_appendix_index": "index",
}


def layout_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAYOUT_CLASSES.items()), "class_id string, operators string")


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AREA_TYPES.items()), "table_type string, display string")
