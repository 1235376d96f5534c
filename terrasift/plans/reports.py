"""Queries over generated reports: record layouts, captions and pages, plans, diagnoses, and the functions under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import labels, lines, numbers, text
from terrasift.operators import classify, corpus, display, documents, gate, index, points
from terrasift.plans import pipeline
from terrasift.plans.catalogue import query, report_pages, table
from terrasift.session import stored
from terrasift.sinks import kml
from terrasift.sources import corpus as sources
from terrasift.streaming import jobs

HEAD = "Datum : ED-50\nTürü : UTM\nZon : 36\n"
#: Offsets of the vertices of a generated ring: no two alike in either axis.
VERTICES = ((0, 0), (200, 10), (210, 200), (5, 190))
_V = "v(i, dy, dx) AS (VALUES " + ", ".join(f"({i}, {dy}, {dx})" for i, (dy, dx) in enumerate(VERTICES)) + ")"
_PLACE = "512300 + s_suppkey % 1000 * 10 + dy AS y, 4301200 + s_suppkey % 500 * 10 + dx AS x"


def vertices(k, east: int = 512300):
    return [(k % 1000 * 10 + east + dy, k % 500 * 10 + 4301200 + dx) for dy, dx in VERTICES]


def row_block(name: str, k, east: int = 512300):
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}{i} "), y.cast("string"), F.lit(".00 "), x.cast("string"), F.lit(".00")) for i, (y, x) in enumerate(vertices(k, east), 1)])


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of one licence table for each supplier, its records in one of seven layouts."""
    k = F.col("s_suppkey").cast("int")
    v = [(F.lit(f"R{i}"), y.cast("string"), x.cast("string"), F.lit(f"39.1{i}"), F.lit(f"33.2{i}"), F.lit(str(i))) for i, (y, x) in enumerate(vertices(k), 1)]
    sp, nl = F.lit(" "), "\n"
    kinds = [
        F.concat_ws(nl, *[F.concat_ws(" ", r, y, x) for r, y, x, *_ in v]),
        F.concat_ws(nl, *[F.concat_ws(nl, r, y, x, lat, lon) for r, y, x, lat, lon, _ in v]),
        F.concat_ws(nl, *[F.concat_ws(nl, r, F.concat_ws(" : ", y, x)) for r, y, x, *_ in v]),
        F.concat_ws(nl, *[F.concat_ws(nl, F.concat_ws(" ", n, lat), F.concat_ws(" ", y, x, lon)) for _, y, x, lat, lon, n in v]),
        F.concat_ws(nl, *[r for r, *_ in v], *[y for _, y, *_ in v], *[x for _, _, x, *_ in v]),
        F.concat_ws(nl, *[F.concat_ws(nl, y, x) for _, y, x, *_ in v], *[F.concat_ws(nl, lat, lon) for _, _, _, lat, lon, _ in v]),
        F.concat_ws(nl, *[F.concat_ws(" ", r, y, x, lat, lon) for r, y, x, lat, lon, _ in v[:2]], *[F.concat(r, sp, F.substring(y, 1, 3), sp, F.substring(y, 4, 3), sp, F.substring(x, 1, 3), sp, F.substring(x, 4, 4), sp, lat, sp, lon) for r, y, x, lat, lon, _ in v[2:]]),
    ]
    body = F.element_at(F.array(*kinds), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("text_layer").alias("source_method"), F.concat(F.lit("Tablo 2. Ruhsat Alanı Koordinatları (4,00 ha)\n" + HEAD), body).alias("text"))


@query(f"""WITH {_V} SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 7 = 3 THEN '' WHEN s_suppkey % 7 = 5 THEN 'P' ELSE 'R' END || (i + 1) AS label, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x,
CAST(CASE WHEN s_suppkey % 7 IN (1, 3, 5, 6) THEN 3911 + i END AS BIGINT) AS lat, CAST(CASE WHEN s_suppkey % 7 IN (1, 3, 5, 6) THEN 3321 + i END AS BIGINT) AS lon,
CASE WHEN s_suppkey % 7 = 6 AND i < 2 THEN 'row' ELSE ['row', 'stacked', 'stacked', 'stitched', 'column', 'run', 'recovered'][s_suppkey % 7 + 1] END AS parser_method FROM (SELECT s_suppkey, i, {_PLACE} FROM supplier, v)""")
def q_layouts(spark, sf_dir):
    """PAR-01..06, PAR-08, PAR-09, FN-13, FN-14, PR-15: every point of reports in seven record layouts, by the whole chain."""
    found = pipeline.run(layouts(spark, sf_dir)).points
    hundred = lambda c: F.round(F.col(c) * 100).cast("long")
    return found.select("doc_id", "label", F.col("utm_y").cast("long").alias("y"), F.col("utm_x").cast("long").alias("x"), hundred("latitude").alias("lat"), hundred("longitude").alias("lon"), "parser_method")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose captions and pages do not stand where they should, in six kinds."""
    k = F.col("s_suppkey").cast("int")
    stock, ced = row_block("S", k), row_block("C", k, 516000)
    caption = lambda no, name: F.lit(f"Tablo {no}. {name} Koordinatları\n")
    head, nl = F.lit(HEAD), F.lit("\n")
    degrees = F.lit("\n" + "\n".join(f"39.1{i} 33.2{i}" for i in range(1, 5)))
    one = [
        F.concat(caption(4, "Stok Alanı"), head, stock, nl, ced, nl, caption(5, "ÇED Alanı"), head),  # the ring stands before its caption
        F.concat(head, stock, nl, caption(6, "Pasa Alanı")),  # rows first, caption last
        F.concat(caption(4, "Stok Alanı"), head, stock),  # goes on on the next page, with a new ring before its caption
        F.concat(caption(4, "Stok Alanı"), head, row_block("S", k)),  # goes on on the next page without a caption
        F.concat(caption(4, "Stok Alanı"), head, stock, degrees),  # a ring of degrees after one of metres
        F.concat(F.lit("Tablo 1. Ocak Alanı Koordinatları\n"), head, stock, F.lit("\nEK-1 SEÇİLEN YERİN KOORDİNATLARI\n"), caption(2, "ÇED Alanı"), head, ced, F.lit("\nKAYNAKÇA\nson")),  # the appendix counts alone
    ]
    two = {2: F.concat(ced, nl, caption(5, "ÇED Alanı"), head), 3: F.concat_ws("\n", *[F.regexp_replace(F.split(row_block("S", k, 518000), "\n")[i], "^S[0-9]", f"S{i + 5}") for i in range(4)])}
    second = F.when(k % 6 == 2, two[2]).when(k % 6 == 3, two[3])
    pages = F.array(F.struct(F.lit(1).alias("page_no"), F.element_at(F.array(*one), (k % 6 + 1).cast("int")).alias("text")), F.struct(F.lit(2).alias("page_no"), second.alias("text")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.inline(pages)).select("doc_id", "page_no", F.lit("text_layer").alias("source_method"), "text")


@query("""WITH k(kind, table_index, area_type, points) AS (VALUES (0, 1, 'STOK_ALANI', 4), (0, 2, 'CED_ALANI', 4), (1, 1, 'PASA_ALANI', 4), (2, 1, 'STOK_ALANI', 4), (2, 2, 'CED_ALANI', 4), (3, 1, 'STOK_ALANI', 8), (4, 1, 'STOK_ALANI', 4), (4, 1, 'CED_ALANI', 4), (5, 1, 'CED_ALANI', 4))
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(table_index AS INTEGER) AS table_index, area_type, CAST(points AS BIGINT) AS points FROM supplier JOIN k ON kind = s_suppkey % 6""")
def q_segmentation(spark, sf_dir):
    """SEG-01..05, PR-16, PAR-07, PAR-13: tables, types and points of misplaced captions, pages and rings."""
    found = documents.points(stored(documents.scanned(segmented(spark, sf_dir))))
    return found.groupBy("doc_id", "table_index", F.col("table_type").alias("area_type")).agg(F.count("*").alias("points"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'UNPAIRED_NUMBERS' ELSE 'NO_COORDINATE_RANGE' END AS finding, CAST(CASE s_suppkey % 3 WHEN 0 THEN 4 ELSE 0 END AS BIGINT) AS points,
CAST(CASE s_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS eastings FROM supplier""")
def q_failures(spark, sf_dir):
    """QA-10: why tables gave nothing."""
    k = F.col("s_suppkey").cast("int")
    body = F.when(k % 3 == 0, row_block("R", k)).when(k % 3 == 1, F.lit("512300\nara metin\n512400\nara metin\n512500\nara metin\n4301200\nara metin")).otherwise(F.lit("R1 17 18\nR2 19 20"))
    tables = table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.lit(1).alias("table_index"), F.concat(F.lit("Tablo 2. Ruhsat Alanı Koordinatları\n"), body).alias("text"))
    scan = documents.scanned(tables.select("doc_id", F.lit(1).alias("page_no"), F.lit("ocr").alias("source_method"), "text"))
    return gate.failure_report(tables, documents.points(scan)).select("doc_id", "finding", "points", "eastings")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS table_index, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, i) AS INTEGER) AS priority, section, CAST(score AS INTEGER) AS section_score, geographic
FROM supplier, (VALUES (1, 'Bilinmeyen Alan', 10, true), (2, 'Ruhsat Alanı', 80, false), (3, 'PROJEYE KONU ALAN', 100, false)) t(i, section, score, geographic)""")
def q_sections(spark, sf_dir):
    """CLS-04, CLS-06, TOP-01: sections, their scores, and the order of tables by them."""
    bodies = ["Enlem Boylam\n39,1 33,2", "12\nRuhsat Alanı\n512300 4301200 512400 4301300", "başlık\nPROJEYE KONU ALAN\n512300 4301200 512400 4301300"]
    rows = F.array(*[F.struct(F.lit(i).alias("table_index"), F.lit(b).alias("text")) for i, b in enumerate(bodies, 1)])
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.inline(rows))
    return classify.prioritised(made).select("doc_id", "table_index", "priority", "section", "section_score", "geographic")


@query("""SELECT l_orderkey, string_agg(DISTINCT CAST(23035 + l_linenumber % 2 AS VARCHAR), ',' ORDER BY CAST(23035 + l_linenumber % 2 AS VARCHAR)) AS codes, CASE WHEN bool_or(l_discount > 0.09) THEN 'CONFLICTING' WHEN bool_and(l_returnflag <> 'R') THEN 'HIGH' ELSE 'UNRESOLVED' END AS confidence FROM lineitem GROUP BY l_orderkey""")
def q_crs_summary(spark, sf_dir):
    """CRS-06 with lines of an order as points of a group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (23035 + F.col("l_linenumber") % 2).cast("int").alias("projected_crs_epsg"), (F.col("l_discount") > 0.09).alias("crs_conflict"), F.when(F.col("l_returnflag") != "R", "HIGH").otherwise("UNRESOLVED").alias("crs_confidence"))
    found = points.crs_summary(rows, ["l_orderkey"])
    return found.select("l_orderkey", F.array_join(F.transform("epsg_codes", lambda c: c.cast("string")), ",").alias("codes"), F.col("group_confidence").alias("confidence"))


@query("""WITH s AS (SELECT l_orderkey % 7 AS page, l_partkey AS y, min(l_returnflag) AS f, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN f ELSE 'DIGER' END AS table_type FROM lineitem LEFT JOIN s ON page = l_orderkey % 7 AND y = l_partkey""")
def q_scopes(spark, sf_dir):
    """CLS-07: types of merged cells on points of the same page and place, where a place has one type."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("page"), (F.col("l_partkey") * 1.0).alias("y"), F.lit(5.0).alias("x"), "l_returnflag")
    scopes = rows.where("l_linenumber = 1").select("page", "y", "x", F.col("l_returnflag").alias("area_type"))
    made = rows.select("l_orderkey", "l_linenumber", F.col("page").alias("source_page"), F.col("y").alias("utm_y"), F.col("x").alias("utm_x"), F.lit("DIGER").alias("table_type"))
    return points.scoped_types(made, scopes).select("l_orderkey", "l_linenumber", "table_type")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS identities FROM supplier""")
def q_table_identity(spark, sf_dir):
    """JN-04, AGG-14: a table read twice, by text layer and OCR, is one table if its points are the same."""
    k = F.col("s_suppkey").cast("int")
    pair = F.array(*[F.struct(F.lit(i).alias("table_index"), F.lit(m).alias("source_method")) for i, m in ((1, "text_layer"), (2, "ocr"))])
    tables = table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.inline(pair)).select("*", F.lit("Tablo 2. Ruhsat").alias("heading"), F.concat(F.lit("text of "), "source_method").alias("text"), F.lit(1).alias("first_page"), F.lit(2).alias("last_page"))
    moved = F.when((F.col("table_index") == 2) & (F.col("doc_id").cast("int") % 3 != 0), 1.0).otherwise(0.0)
    each = tables.select("doc_id", "table_index", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("doc_id", "table_index", (512300.0 + F.col("i") + moved).alias("utm_y"), (4301200.0 + F.col("i")).alias("utm_x"), F.concat(F.lit("R"), F.col("i").cast("string")).alias("label"))
    return points.table_identity(tables, each).groupBy("doc_id").agg(F.count_distinct("table_identity").alias("identities"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of twelve pages: an index on the second that names a table, found on the ninth under its title,
    and another whose caption stands nowhere; reports of every third supplier have no index."""
    k = F.col("s_suppkey")
    front = F.when(k % 3 == 0, "Genel").otherwise("TABLOLAR DİZİNİ\nTablo 3. ÇED Alanı Koordinatları ....... 7\nTablo 4. Stok Alanı Koordinatları ....... 4\nTablo 5. Bitki Türleri ....... 9\nKAYNAKÇA")
    no = F.col("page_no")
    body = F.when(no == 2, front).when(no == 9, "Tablo 3. ÇED Alanı Koordinatları\nDatum : ED-50 UTM\n512300 4301200\n512400 4301300").otherwise("metin")
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), k, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page_no")).select("doc_id", "page_no", F.lit("text_layer").alias("source_method"), body.alias("text"))


@query("""SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(p AS INTEGER) AS page_no, CASE WHEN s_suppkey % 3 = 0 THEN 'SCORE' ELSE 'INDEX' END AS reason FROM supplier, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 3 = 0 THEN range(8, 13) ELSE list_concat(range(8, 13), range(5, 10)) END) AS p) t""")
def q_index_plan(spark, sf_dir):
    """ORC-04, JN-05, WIN-03, WIN-04, TOP-02: pages by the index, the unresolved table by the others' offset, else by score."""
    return index.plan(indexed(spark, sf_dir))


@query("SELECT count(*) AS documents, count(*) FILTER (s_suppkey % 3 > 0) AS with_index, count(*) FILTER (s_suppkey % 3 > 0) AS with_entries, count(*) FILTER (s_suppkey % 3 > 0) AS with_pages, CASE WHEN count(*) FILTER (s_suppkey % 3 > 0) / count(*) >= 0.5 THEN 'INDEX_FIRST' ELSE 'INDEX_THEN_SCORE' END AS recommendation FROM supplier")
def q_index_analysis(spark, sf_dir):
    """ORC-09."""
    return index.analysis(indexed(spark, sf_dir))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'COMPLETE' WHEN s_suppkey % 3 = 1 THEN 'USEFUL_PARTIAL' ELSE 'EMPTY' END AS completeness, 'HYBRID' AS stage FROM supplier""")
def q_ladder(spark, sf_dir):
    """ORC-02, ORC-03, AGG-11, SRC-03: text pages of nothing, then OCR of both tables, one, or none."""
    from terrasift.plans import acquisition

    k = F.col("doc_id").cast("int")
    whole = report_pages(spark, sf_dir)
    read = whole.withColumn("text", F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.regexp_extract("text", r"(?s)^(.*?)\nTablo 3", 1)).otherwise("okunamadı"))
    blank = whole.withColumn("text", F.lit("x"))
    found = acquisition.climb([("FULL_TEXT", blank), ("HYBRID", sources.hybrid(blank, read))])
    last = found.attempts.where("stage = 'HYBRID'")
    return last.select("doc_id", "completeness", "stage")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS job_id, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'FAILED' ELSE 'COMPLETED' END AS status, ['NO_RESULT', 'FILE_CHANGED', 'SAME_GEOMETRY', 'NEW_UNIQUE_GEOMETRY'][s_suppkey % 4 + 1] AS reason FROM supplier""")
def q_worker(spark, sf_dir):
    """STR-04, SET-01: what a worker makes of its claimed jobs."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("job_id"), k.alias("k"), F.lit("a").alias("identity"), F.array(F.lit("t1")).alias("tokens"), F.array().cast("array<string>").alias("rings"))
    refined = rows.where("k % 4 > 0").withColumn("identity", F.when(F.col("k") % 4 == 1, "b").otherwise("a")).withColumn("tokens", F.when(F.col("k") % 4 == 3, F.array(F.lit("t1"), F.lit("t2"))).otherwise(F.col("tokens")))
    return jobs.outcomes(rows, rows, refined)


@query("""WITH l AS (SELECT n_nationkey, max(o_orderkey) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey),
s AS (SELECT n.n_nationkey AS province, coalesce(CASE WHEN m % 3 = 0 THEN 'completed' WHEN m % 3 = 1 THEN 'failed' WHEN m % 3 = 2 THEN 'in_progress' END, 'pending') AS state FROM nation n LEFT JOIN l ON l.n_nationkey = n.n_nationkey) SELECT *, state <> 'completed' AS due FROM s""")
def q_provinces(spark, sf_dir):
    """STR-06: nations as provinces, orders as attempts."""
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("province"))
    outcome = F.element_at(F.array(F.lit("completed"), F.lit("failed"), F.lit("in_progress")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    attempts = table(spark, sf_dir, "orders").join(owner, "o_custkey").select("province", F.col("o_orderkey").alias("seq"), outcome.alias("outcome"))
    return jobs.province_states(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("province")), attempts, retry_failed=True)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '[ERROR] CRS_UNRESOLVED_NO_TRANSFORM table=1 points=4' AS line FROM supplier""")
def q_diagnostic_text(spark, sf_dir):
    """QA-08."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit("CRS_UNRESOLVED_NO_TRANSFORM").alias("code"), F.lit("error").alias("severity"), F.lit(1).alias("table_index"), F.lit(None).cast("string").alias("polygon_group"), F.lit(4).alias("point_count"))
    return gate.as_text(rows)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 5 = 0 THEN 'AREA_MISMATCH ÇED' ELSE '' END <> '' AS blocked, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS kml FROM supplier""")
def q_quarantine(spark, sf_dir):
    """SNK-01, SNK-04, SNK-05: a document has a KML text or a place in the quarantine, never both."""
    project = pipeline.run(report_pages(spark, sf_dir))
    texts = kml.documents(kml.placemarks(gate.exportable(project.rings, project.gate))).where(F.col("kml").contains("Beyan (ha)")).select("doc_id", F.lit(1).alias("kml"))
    held = kml.quarantine(project.gate, project.reasons).where(F.col("message").contains("AREA_MISMATCH")).select("doc_id", F.lit(True).alias("blocked"))
    return project.documents.select("doc_id").join(texts, "doc_id", "left").join(held, "doc_id", "left").na.fill({"kml": 0}).select("doc_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), "kml")


# ---- sources ----------------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(p AS INTEGER) AS page_no, CASE WHEN p = 1 THEN 'text_layer' ELSE 'ocr' END AS source_method, sha256(CASE WHEN p = 1 THEN replace(coalesce(text, ''), chr(13), '') ELSE 'son' END) AS digest FROM documents, (VALUES (1), (2)) t(p)""")
def q_pages_of(spark, sf_dir):
    """SRC-01, SRC-06: pages of marked documents, the whole text on the first."""
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    marked = F.concat(text.page_marker(F.lit(1), F.lit("PDF METİN KATMANI")), F.lit("\n"), plain, F.lit("\n"), text.page_marker(F.lit(2), F.lit("OCR")), F.lit("\nson"))
    found = sources.pages_of(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")))
    return found.select("doc_id", "page_no", "source_method", F.sha2("text", 256).alias("digest"))


@query("""SELECT page_id, 'wanted' AS kind, count(*) AS n FROM (SELECT page_id, unnest(range(1, 4)) AS p FROM pages) WHERE p % 2 = page_id % 2 GROUP BY page_id
UNION ALL SELECT page_id, 'missing', CAST(1 AS BIGINT) FROM pages""")
def q_page_subset(spark, sf_dir):
    """SRC-02, SRC-04: pages asked for of three, and a ninth that none has."""
    three = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"))
    asked = three.where(F.col("page_no") % 2 == F.col("doc_id") % 2).union(three.select("doc_id", F.lit(9)))
    kept, missing = sources.subset(three, asked)
    counted = lambda df, kind: df.groupBy(F.col("doc_id").alias("page_id")).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return counted(kept, "wanted").union(counted(missing, "missing"))


@query("SELECT doc_id, doc_id % 3 AS page_no, CASE WHEN doc_id % 5 > 0 OR doc_id % 2 = 0 THEN 'text_layer' ELSE 'ocr' END AS source_method FROM documents")
def q_hybrid(spark, sf_dir):
    """SRC-03, SRC-05: long texts win over OCR, short ones lose to it where there is any."""
    body = F.when(F.col("doc_id") % 5 > 0, F.repeat(F.lit("uzun metin "), 12)).otherwise("kısa")
    texts = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("page_no"), body.alias("text"))
    return sources.hybrid(texts, texts.where("doc_id % 2 = 1").withColumn("text", F.lit("ocr"))).select("doc_id", "page_no", "source_method")


@query("""SELECT o_orderkey AS doc_id, CAST(o_custkey % 9 AS INTEGER) AS page, 'row' AS kind, CAST(o_custkey % 3 + 1 AS BIGINT) AS n FROM orders UNION ALL SELECT o_orderkey, CAST(o_custkey % 9 AS INTEGER), 'cell', CAST(2 AS BIGINT) FROM orders""")
def q_layout_rows(spark, sf_dir):
    """SRC-07: rows and cells of nested page layouts."""
    box = lambda i: F.struct(i.cast("double").alias("y0"), (i + 1).cast("double").alias("y1"))
    inner = F.struct(F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 3).cast("int")), box).alias("rows"), F.transform(F.sequence(F.lit(0), F.lit(1)), box).alias("cells"))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 9).cast("int").alias("page"), F.array(inner).alias("tables"))
    rows, cells = sources.layout_rows(made)
    counted = lambda df, kind: df.groupBy("doc_id", "page").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return counted(rows, "row").union(counted(cells, "cell"))


@query("""SELECT p_partkey, ['ABSOLUTE', 'OUTSIDE_ROOT', 'NOT_PDF', 'MISSING', NULL][p_partkey % 5 + 1] AS reason FROM part""")
def q_manifest(spark, sf_dir):
    """SRC-10: lines of a manifest against a listing."""
    k = F.col("p_partkey")
    name = k.cast("string")
    kinds = [F.concat(F.lit("/a/"), name, F.lit(".pdf")), F.concat(F.lit("../"), name, F.lit(".pdf")), F.concat(name, F.lit(".txt")), F.concat(name, F.lit("-none.pdf")), F.concat(name, F.lit(".pdf"))]
    line = F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))
    part = table(spark, sf_dir, "part")
    found = sources.manifest(part.select(line.alias("value")), part.select(F.concat(name, F.lit(".pdf")).alias("relative_path")))
    return found.select(F.regexp_extract("relative_path", "([0-9]+)", 1).cast("long").alias("p_partkey"), "reason")


@query("""SELECT count(*) AS n, sha256(string_agg(DISTINCT n_name || '.pdf', chr(10) ORDER BY n_name || '.pdf')) AS digest FROM nation""")
def q_manifest_digest(spark, sf_dir):
    """SRC-10, SNK-08: count and digest of a manifest's lines."""
    return sources.manifest_digest(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".pdf")).alias("relative_path")))


@query("""SELECT o_custkey AS report_id, o_orderkey AS attempts, o_orderpriority AS stage FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) JOIN customer ON c_custkey = o_custkey WHERE k = 1 AND o_orderstatus = 'F'""")
def q_download_failures(spark, sf_dir):
    """SRC-15: orders as attempts at a customer's report; the last one decides."""
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return sources.download_failures(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id")), attempts).select("report_id", "attempts", "stage")


@query("""SELECT lang, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(regexp_replace(text, '\\s', '', 'g'))) < 50 * count(*) AS ocr_needed FROM documents GROUP BY lang""")
def q_analyzed(spark, sf_dir):
    """SRC-17: languages as documents, documents as pages."""
    return sources.analyzed(table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), "text")).withColumnRenamed("doc_id", "lang")


@query("SELECT doc_id, doc_id % 2 = 0 AS pdf FROM documents")
def q_is_pdf(spark, sf_dir):
    """SRC-14: the magic bytes."""
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-1.7")).otherwise("PK.."), F.coalesce("text", F.lit(""))).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", sources.is_pdf(content).alias("pdf"))


# ---- functions --------------------------------------------------------------------------


@query("""WITH k AS (SELECT o_orderkey, 100000 + o_orderkey % 900000 AS y, 3000000 + o_custkey % 2000000 AS x FROM orders)
SELECT o_orderkey, 'R1|' || y // 1000 || ' ' || lpad(CAST(y % 1000 AS VARCHAR), 3, '0') || '|' || x // 1000000 || ' ' || lpad(CAST(x // 1000 % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0') AS tokens, CAST(y AS BIGINT) AS y FROM k""")
def q_line_tokens(spark, sf_dir):
    """FN-05, FN-06: blank-grouped coordinates rejoined after a split at blanks and colons."""
    y, x = 100000 + F.col("o_orderkey") % 900000, 3000000 + F.col("o_custkey") % 2000000
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    line = F.concat(F.lit("R1 : "), F.expr("(100000 + o_orderkey % 900000) div 1000").cast("string"), F.lit(" "), three(y % 1000), F.lit(" : "), F.floor(x / 1000000).cast("string"), F.lit(" "), three(F.floor(x / 1000) % 1000), F.lit(" "), three(x % 1000))
    found = table(spark, sf_dir, "orders").select("o_orderkey", numbers.line_tokens(line).alias("t"))
    return found.select("o_orderkey", F.array_join("t", "|").alias("tokens"), F.element_at(numbers.values_of(F.col("t")), 1).cast("long").alias("y"))


@query("""SELECT s_suppkey, CAST(512000 + s_suppkey % 1000 AS BIGINT) AS whole, s_suppkey % 2 = 0 AS label, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS INTEGER) AS page, 'I.' || s_suppkey AS roman FROM supplier""")
def q_small_functions(spark, sf_dir):
    """FN-09, FN-13, FN-19, FN-20: lost decimal marks, labels, printed pages, table numbers."""
    k = F.col("s_suppkey")
    lost = F.concat((512000 + k % 1000).cast("string"), F.lit("250"))
    token = F.when(k % 2 == 0, F.concat(F.lit("R."), k.cast("string"))).otherwise("512300")
    printed = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" - "), (k + 1).cast("string"))).otherwise("s. x")
    return table(spark, sf_dir, "supplier").select(k, F.floor(numbers.recover_decimal(lost)).cast("long").alias("whole"), labels.is_label(token).alias("label"), numbers.printed_page(printed)["page"].alias("page"), F.element_at(labels.table_no_variants(F.concat(F.lit("1,"), k.cast("string"))), 2).alias("roman"))


@query("""SELECT s_suppkey, 'FIRMA ' || s_suppkey AS cleaned, '{"s_suppkey":' || s_suppkey || '}' AS snapshot, CAST(2 AS INTEGER) AS pairs FROM supplier""")
def q_display_functions(spark, sf_dir):
    """FN-22, FN-25, FN-26: cleaned values, snapshots of present fields, adjacent pairs before a total."""
    k = F.col("s_suppkey")
    raw = F.concat(F.lit(" :  FIRMA   "), k.cast("string"), F.lit(" Tel: 0312"))
    body = F.concat(F.lit("R1 512300 4301200 R2 512400 4301300 TOPLAM ALAN 512500 4301400 "), k.cast("string"))
    rows = table(spark, sf_dir, "supplier").select(k, text.clean_value(raw).alias("cleaned"), F.size(display.adjacent_pairs(body)).alias("pairs"))
    return display.snapshot(rows, ["s_suppkey", "absent"]).select("s_suppkey", "cleaned", "snapshot", "pairs")


_LINES = (
    ("Datum : ED-50", "noise"), ("R1 512300 4301200", "data"), ("Sağa (Y)", "column_header"), ("Tablo 4. Stok Alanı Koordinatları", "numbered,table_start,late_caption"),
    ("ÇED Alanı Koordinatları", "table_start,late_caption"), ("Toplam Alan : 5 ha", "table_end"), ("2.1. Jeoloji", "section_start"), ("Tablolar Dizini", "index_heading"),
    ("İçindekiler", "toc_heading"), ("EK-7 Harita", "unrelated_section"), (":", "noise"), ("düz metin", ""),
)


@query("SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{flags}'" for i, (_, flags) in enumerate(_LINES)) + " END AS flags FROM part")
def q_line_flags(spark, sf_dir):
    """PR-01..07, PR-10..12: the predicates that hold of a dozen kinds of lines."""
    line = F.element_at(F.array(*[F.lit(x) for x, _ in _LINES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    held = [F.when(c, name) for name, c in lines.flags(F.col("line")).items()]
    return rows.select("p_partkey", F.concat_ws(",", *held).alias("flags"))


@query("""SELECT s_suppkey, s_suppkey % 3 <> 2 AS real, s_suppkey % 2 = 0 AS licence, s_suppkey % 4 = 0 AS company FROM supplier""")
def q_text_predicates(spark, sf_dir):
    """PR-08, PR-09, PR-13, PR-14: real tables, plausible licences, company names."""
    k = F.col("s_suppkey").cast("int")
    body = F.concat(F.when(k % 3 == 2, F.lit("Sondaj Koordinatları\n")).otherwise("Ruhsat Koordinatları\n"), row_block("R", k))
    licence = F.when(k % 2 == 0, (10000 + k % 80000).cast("string")).otherwise((3000000 + k % 1000).cast("string"))
    name = F.when(k % 4 == 0, "Demir Madencilik A.Ş.").otherwise("Genel Bilgiler")
    return table(spark, sf_dir, "supplier").select("s_suppkey", lines.is_real_table(body).alias("real"), lines.plausible_licence(licence, False).alias("licence"), lines.looks_like_company(name).alias("company"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'the')) + len(regexp_extract_all(coalesce(text, ''), 'and')) AS hits FROM documents""")
def q_keyword_hits(spark, sf_dir):
    """AGG-15."""
    return table(spark, sf_dir, "documents").select("doc_id", corpus.keyword_hits(F.coalesce("text", F.lit("")), ["the", "and"]).cast("long").alias("hits"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 'ÖRNEK MADENCİLİK SANAYİ VE TİCARET LTD. ŞTİ.' AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'KUVARSİT / ÇİNKO' ELSE 'KROM' END AS mine_type, 'ADANA' AS province, 'KOZAN' AS district FROM supplier""")
def q_cover(spark, sf_dir):
    """MD-03, MD-04, MD-06, PR-13: a company over two lines, mines by their nouns, province and district."""
    k = F.col("s_suppkey")
    mine = F.when(k % 2 == 0, "KUVARSİT VE ÇİNKO OCAĞI, Kuvarsit Ocağı").otherwise("KROM MADENİ")
    cover = F.concat(F.lit("ÇED RAPORU\nÖRNEK MADENCİLİK SANAYİ\nVE TİCARET LTD. ŞTİ.\nADANA İLİ KOZAN İLÇESİ\n"), mine)
    found = pipeline.metadata.extract(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), cover.alias("text"), F.lit(None).cast("string").alias("path")))
    return found.select("doc_id", "company", "mine_type", "province", "district")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_suppkey % 4 = 0 AS far FROM supplier""")
def q_province_check(spark, sf_dir):
    """QA-05: rings near their province and far from it."""
    k = F.col("s_suppkey")
    lon = F.when(k % 4 == 0, 44.0).otherwise(35.5)
    vertex = F.struct(F.lit(0).alias("seq"), F.lit("P").alias("name"), (k * 1.0 + 500000).alias("y"), F.lit(4300000.0).alias("x"), F.lit(37.0).alias("lat"), lon.alias("lon"))
    made = table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.array(vertex).alias("points"), F.lit("RUHSAT_ALANI").alias("table_type"), F.lit("POLYGON").alias("geometry_type"), F.lit(None).cast("double").alias("declared_ha"), F.lit(4.0).alias("area_ha"), F.lit("").alias("polygon_heading"), F.lit("").alias("section"), F.lit("DEFAULT").alias("polygon_group"), F.lit(1).alias("table_index"))
    documents_ = made.select("doc_id", F.lit("Adana").alias("province"))
    far = gate.reasons(gate.annotated(made), documents_).where("code = 'CRS_LONLAT_OUT_OF_RANGE'").select("doc_id", F.lit(True).alias("far"))
    return documents_.select("doc_id").join(far, "doc_id", "left").na.fill({"far": False})


@query("SELECT class_id FROM (VALUES " + ", ".join(f"('{c}')" for c in gate.LAYOUT_CLASSES) + ") t(class_id)")
def q_layout_classes(spark, sf_dir):
    """QA-09."""
    return gate.layout_classes(spark).select("class_id")


@query("""SELECT o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(round(850.0 * (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6) AS DOUBLE) AS px FROM orders WINDOW w AS (PARTITION BY o_custkey) QUALIFY max(o_totalprice) OVER w > min(o_totalprice) OVER w""")
def q_canvas(spark, sf_dir):
    """API-03: prices as longitudes of a customer's map."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("lon"), F.col("o_totalprice").alias("lat"))
    several = rows.groupBy("o_custkey").agg((F.max("lon") > F.min("lon")).alias("_s")).where("_s").drop("_s")
    placed = display.on_canvas(rows.join(several, "o_custkey", "left_semi"), keys=("o_custkey",))
    return placed.select("o_custkey", "o_orderkey", F.round("canvas_x", 6).alias("px"))
