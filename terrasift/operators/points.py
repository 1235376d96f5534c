"""Points after parsing: duplicates, attestation, CRS choice and conflicts, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import crs
from terrasift.functions.numbers import canonical_decimal, declared_hectares, declared_list, number_tokens


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AGG-01: the first row of each key in the given order (null keys are a key)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def latest_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AGG-10: the last row of each identity; rows without identity are all kept."""
    has = F.lit(True)
    for k in keys:
        has = has & F.col(k).isNotNull()
    window = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    ranked = df.where(has).withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")
    return ranked.unionByName(df.where(~has))


def attested(points: DataFrame, text: str = "_text", tolerance: float = 0.6) -> DataFrame:
    """PR-15: points whose UTM or geographic values occur in their table's text; all of a table if none does."""
    tokens = number_tokens(F.regexp_replace(text, r"\n", " ; "))
    near = lambda v: F.exists("_tokens", lambda t: F.abs(t - v) <= tolerance)
    kept = (near(F.col("utm_y")) & near(F.col("utm_x"))) | (near(F.col("latitude")) & near(F.col("longitude")))
    window = Window.partitionBy("doc_id", "table_index")
    held = points.withColumn("_tokens", tokens).withColumn("_kept", F.coalesce(kept, F.lit(False))).drop("_tokens")
    return held.withColumn("_any", F.max("_kept").over(window)).where(F.col("_kept") | ~F.col("_any")).drop("_kept", "_any")


def table_crs(tables: DataFrame) -> DataFrame:
    """CRS-01, CRS-02, CRS-04: each table's datum and EPSG code: its own if certain, else by its
    central meridian, else the last certain table's, else the document's only one."""
    own = tables.withColumn("crs", crs.datums(F.col("text")))
    inferred = F.when((F.col("crs.confidence") != "CONFLICTING") & (F.coalesce(F.col("crs.projection"), F.lit(6)) != 3) & F.col("crs.datum").isNotNull(), crs.epsg_of(F.col("crs.datum"), crs.zone_from_dom(F.col("crs.dom"))))
    local = F.coalesce(F.when(F.col("crs.confidence") == "HIGH", crs.epsg_of(F.col("crs.datum"), F.col("crs.zone"))), inferred)
    own = own.withColumn("local_epsg", local)
    before = Window.partitionBy("doc_id").orderBy("table_index").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    high = F.when(F.col("crs.confidence") == "HIGH", F.col("local_epsg"))
    carried = F.last_value(high, ignoreNulls=F.lit(True)).over(before)
    only = F.when(F.size(F.collect_set(high).over(whole)) == 1, F.element_at(F.collect_set(high).over(whole), 1))
    chosen = own.withColumn("epsg", F.when(F.col("crs.confidence") == "CONFLICTING", F.col("local_epsg")).otherwise(F.coalesce("local_epsg", carried, only)))
    source = F.when(F.col("local_epsg").isNotNull(), "LOCAL").when(F.col("epsg").isNotNull(), "INHERITED").otherwise("UNRESOLVED")
    return chosen.withColumn("crs_source", source)


def transformed(points: DataFrame, tables: DataFrame) -> DataFrame:
    """CRS-03: points with their table's code and WGS84 position; geographic ones keep their own."""
    codes = tables.select("doc_id", "table_index", F.col("epsg").alias("projected_crs_epsg"), "crs_source", F.col("crs.confidence").alias("crs_confidence"), "heading", F.col("text").alias("_text"))
    out = crs.with_wgs84(points.join(codes, ["doc_id", "table_index"], "left"), "utm_y", "utm_x", "projected_crs_epsg", "wgs_lon", "wgs_lat")
    bare = F.col("utm_y").isNull()
    return out.withColumns({"transformed_longitude": F.when(bare, F.col("longitude")).otherwise(F.col("wgs_lon")), "transformed_latitude": F.when(bare, F.col("latitude")).otherwise(F.col("wgs_lat"))}).drop("wgs_lon", "wgs_lat")


def with_conflicts(points: DataFrame, y: str = "utm_y", x: str = "utm_x", epsg: str = "projected_crs_epsg", doc: str = "doc_id") -> DataFrame:
    """CRS-05: the same exact pair under two codes in a document conflicts; all its codes are listed."""
    keyed = points.withColumn("_y", canonical_decimal(F.col(y))).withColumn("_x", canonical_decimal(F.col(x)))
    codes = F.array_sort(F.collect_set(epsg).over(Window.partitionBy(doc, "_y", "_x")))
    some = F.col("_y").isNotNull() & F.col("_x").isNotNull() & (F.size(codes) > 1)
    return keyed.withColumn("crs_conflict", F.coalesce(some, F.lit(False))).withColumn("crs_conflicting_epsg", F.when(some, codes).otherwise(F.array().cast("array<int>"))).drop("_y", "_x")


def crs_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """CRS-06: codes and confidence of a group: CONFLICTING over HIGH (all) over UNRESOLVED."""
    return points.groupBy(*keys).agg(*crs_aggregates())


def crs_aggregates() -> list[Column]:
    """CRS-06 as aggregates beside others of the same grouping."""
    clash = F.bool_or(F.coalesce(F.col("crs_conflict"), F.lit(False)) | (F.coalesce(F.col("crs_confidence"), F.lit("")) == "CONFLICTING"))
    rank = F.when(clash, "CONFLICTING").when(F.bool_and(F.coalesce(F.col("crs_confidence") == "HIGH", F.lit(False))), "HIGH").otherwise("UNRESOLVED")
    return [F.array_sort(F.collect_set("projected_crs_epsg")).alias("epsg_codes"), rank.alias("group_confidence")]


def with_declared(points: DataFrame) -> DataFrame:
    """AGG-13: hectares declared by a group's heading, else by its section; the table's single
    declaration where exactly one group lacks one."""
    group = Window.partitionBy("doc_id", "table_index", "polygon_group")
    table = Window.partitionBy("doc_id", "table_index")
    own = F.first_value(declared_hectares(F.col("polygon_heading")), ignoreNulls=F.lit(True)).over(group.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = points.withColumn("_own", F.coalesce(own, declared_hectares(F.col("heading"))))
    lacking = F.size(F.collect_set(F.when(F.col("_own").isNull(), F.col("polygon_group"))).over(table))
    listed = declared_list(F.col("_text"))
    return out.withColumn("declared_ha", F.coalesce("_own", F.when((lacking == 1) & (F.size(listed) == 1), F.element_at(listed, 1)))).drop("_own", "_text")


def observation_identity(tables: DataFrame) -> DataFrame:
    """AGG-14: digest of method, page span and squeezed text; repeats get an ordinal."""
    digest = F.sha2(F.concat_ws("|", "source_method", F.col("first_page").cast("string"), F.col("last_page").cast("string"), F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    marked = tables.withColumn("_digest", digest).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy("table_index")))
    return marked.withColumn("observation_identity", F.when(F.col("_n") == 1, F.col("_digest")).otherwise(F.concat_ws("#", "_digest", F.col("_n").cast("string")))).drop("_digest", "_n")


def table_identity(tables: DataFrame, points: DataFrame) -> DataFrame:
    """JN-04: a text-layer and an OCR table of overlapping pages with the same heading, points and
    labels share an identity when each is the other's only match.

    Equal content is one join key; pages are the residual predicate.
    """
    content = points.groupBy("doc_id", "table_index").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", canonical_decimal(F.col("utm_y")), canonical_decimal(F.col("utm_x")), F.col("label")))), "\n"), 256).alias("_content"))
    keyed = observation_identity(tables).join(content, ["doc_id", "table_index"])
    side = lambda m, p: keyed.where(F.col("source_method") == m).select("doc_id", F.upper(F.trim("heading")).alias("_h"), "_content", *[F.col(c).alias(p + c) for c in ("table_index", "first_page", "last_page", "observation_identity")])
    met = side("text_layer", "a_").join(side("ocr", "b_"), ["doc_id", "_h", "_content"]).where("a_first_page <= b_last_page and b_first_page <= a_last_page")
    only = met.withColumn("_a", F.count("*").over(Window.partitionBy("doc_id", "a_table_index"))).withColumn("_b", F.count("*").over(Window.partitionBy("doc_id", "b_table_index"))).where("_a = 1 and _b = 1")
    shared = only.select("doc_id", F.inline(F.array(F.struct(F.col("a_table_index").alias("table_index"), F.col("a_observation_identity").alias("_id")), F.struct(F.col("b_table_index").alias("table_index"), F.col("a_observation_identity").alias("_id")))))
    out = observation_identity(tables).join(shared, ["doc_id", "table_index"], "left")
    return out.withColumn("table_identity", F.coalesce("_id", "observation_identity")).drop("_id")


def covered_rows(cells: DataFrame, rows: DataFrame, slack: float = 0.01) -> DataFrame:
    """SEG-08, JN-06: rows whose box lies within a cell's box on the same page (range join)."""
    c, r = cells.alias("c"), rows.alias("r")
    inside = (F.col("r.page") == F.col("c.page")) & (F.col("r.y0") >= F.col("c.y0") - slack) & (F.col("r.y1") <= F.col("c.y1") + slack)
    return c.join(r, inside).select("c.page", "c.cell_id", "r.row_id")


def scoped_types(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """CLS-07: a merged cell's area type replaces that of exactly matching points if it is the only one."""
    key = lambda y, x: [canonical_decimal(F.col(y)).alias("_y"), canonical_decimal(F.col(x)).alias("_x")]
    single = scopes.select("page", *key("y", "x"), "area_type").groupBy("page", "_y", "_x").agg(F.collect_set("area_type").alias("_types")).where(F.size("_types") == 1).select("page", "_y", "_x", F.element_at("_types", 1).alias("_scope"))
    keyed = points.select("*", *key("utm_y", "utm_x"))
    joined = keyed.join(single, (keyed["source_page"] == single["page"]) & keyed["_y"].eqNullSafe(single["_y"]) & keyed["_x"].eqNullSafe(single["_x"]), "left")
    return joined.select(*[keyed[c] for c in points.columns if c != "table_type"], F.coalesce("_scope", keyed["table_type"]).alias("table_type"))


def token(epsg: Column, y: Column, x: Column) -> Column:
    from terrasift.functions.numbers import projected_token

    return projected_token(epsg, y, x)
