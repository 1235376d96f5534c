"""Sources: marked text, page subsets, layouts, corpus listings, manifests, results, HTML links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions.text import usable

EXCLUDED_DIRECTORIES = ("benchmark", "output", "preflight")
PAGE_LINE = r"^--- Sayfa ([0-9]+) \[(.*)\] ---$"


def lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """SRC-06, SEG-06, WIN-01: lines of marked text with page and method carried from the last marker.

    An unknown method clears both.  Columns: doc_id, line_no, page_no, source_method, text.
    """
    split = documents.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "text"))
    marker = F.col("text").rlike(PAGE_LINE)
    name = F.upper(F.regexp_extract("text", PAGE_LINE, 2))
    method = F.when(name.contains("METİN") | name.contains("METIN") | name.contains("TEXT"), "text_layer").when(name.contains("OCR"), "ocr")
    state = F.when(marker, F.struct(F.when(method.isNotNull(), F.regexp_extract("text", PAGE_LINE, 1).cast("int")).alias("page"), method.alias("method")))
    window = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = split.withColumn("_s", F.last_value(state, ignoreNulls=F.lit(True)).over(window))
    return carried.where(~marker).select("doc_id", "line_no", F.col("_s.page").alias("page_no"), F.col("_s.method").alias("source_method"), "text")


def pages_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """SRC-01: the pages table of marked text; lines before any marker are page null."""
    rows = lines(documents, text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n")
    return rows.groupBy("doc_id", "page_no", "source_method").agg(joined.alias("text"))


def limited(pages: DataFrame, max_pages: int) -> DataFrame:
    """SRC-01: pages up to a number; blank ones skipped."""
    return pages.where((F.col("page_no") <= max_pages) & (F.trim("text") != ""))


def subset(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-02, SRC-04: (pages wanted, wanted pages that do not exist)."""
    distinct = wanted.select("doc_id", "page_no").distinct()
    return pages.join(distinct, ["doc_id", "page_no"], "left_semi"), distinct.join(pages, ["doc_id", "page_no"], "left_anti")


def hybrid(text_pages: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """SRC-03: per page the text layer if usable, else OCR, else the raw text layer."""
    t, o = text_pages.alias("t"), ocr_pages.alias("o")
    joined = t.join(o, ["doc_id", "page_no"], "full_outer")
    good = F.coalesce(usable(F.col("t.text")), F.lit(False))
    chosen = F.when(good | F.col("o.text").isNull(), F.struct(F.col("t.text").alias("text"), F.lit("text_layer").alias("source_method"))).otherwise(F.struct(F.col("o.text").alias("text"), F.lit("ocr").alias("source_method")))
    return joined.select("doc_id", "page_no", chosen.alias("c")).select("doc_id", "page_no", "c.source_method", "c.text")


def layout_rows(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-07: (rows, cells) of nested page layouts: tables array<struct<rows, cells>>."""
    tables = layouts.select("doc_id", "page", F.posexplode("tables").alias("table_no", "t"))
    rows = tables.select("doc_id", "page", "table_no", F.posexplode("t.rows").alias("row_id", "r")).select("doc_id", "page", "table_no", "row_id", "r.*")
    cells = tables.select("doc_id", "page", "table_no", F.posexplode("t.cells").alias("cell_id", "c")).select("doc_id", "page", "table_no", "cell_id", "c.*")
    return rows, cells


def path_parts(path: Column) -> Column:
    """Province and project type of a path whose file lies under ``<province>/<EK-n>/``."""
    pattern = r"(?i)(?:^|/)([^/]+)/(EK-[12])/"
    return F.struct(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias("province"), F.nullif(F.upper(F.regexp_extract(path, pattern, 2)), F.lit("")).alias("project_type"))


def discovered(spark: SparkSession, root: str, excluded: str | None = None, preflight: bool = False) -> DataFrame:
    """SRC-08, SRC-09: the PDF files under a folder with context, size and modification time.

    Only names and sizes are read, not contents.  ``excluded`` leaves out an output folder;
    ``preflight`` leaves out fixed working folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", F.col("length").alias("size"), "modificationTime")
    out = files.select("path", F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("relative_path"), "size", "modificationTime")
    out = out.withColumn("_p", path_parts(F.col("relative_path"))).select("*", "_p.province", "_p.project_type").drop("_p")
    if excluded:
        out = out.where(~F.col("path").contains(excluded.rstrip("/") + "/"))
    if preflight:
        out = out.where(~F.arrays_overlap(F.split(F.lower("relative_path"), "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES])))
    return out.orderBy(F.lower("relative_path"))


def manifest(lines_: DataFrame, listing: DataFrame, column: str = "value") -> DataFrame:
    """SRC-10: manifest lines with the reason each is rejected, null if it is accepted."""
    path = F.trim(F.regexp_replace(column, "^﻿", ""))
    rows = lines_.select(path.alias("relative_path")).where("relative_path <> ''")
    known = listing.select("relative_path").distinct().withColumn("_known", F.lit(True))
    twice = F.count("*").over(Window.partitionBy(F.lower("relative_path"))) > 1
    reason = F.when(F.col("relative_path").rlike(r"^(?:/|[A-Za-z]:)"), "ABSOLUTE").when(F.col("relative_path").rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)"), "OUTSIDE_ROOT").when(~F.lower("relative_path").endswith(".pdf"), "NOT_PDF").when(F.col("_twice"), "DUPLICATE").when(F.col("_known").isNull(), "MISSING")
    return rows.withColumn("_twice", twice).join(known, "relative_path", "left").select("relative_path", reason.alias("reason"))


def manifest_digest(accepted: DataFrame) -> DataFrame:
    """SRC-10, SNK-08: count and SHA-256 of the sorted lines of a manifest (a bounded list)."""
    return accepted.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("relative_path")), "\n"), 256).alias("digest"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-11: JSON lines without the malformed ones, or CSV with a header."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED")
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """SRC-13: distinct links of pages: href values and window.open targets, entities decoded,
    relative ones resolved against the page's host."""
    found = F.array_union(F.regexp_extract_all(html, F.lit(r"""href\s*=\s*"([^"]*)\""""), 1), F.regexp_extract_all(html, F.lit(r"""window\.open\(\s*'([^']*)'"""), 1))
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    absolute = F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(host, F.lit("/"), link))
    return pages.select(key, url, F.explode(found).alias("link")).select(key, absolute.alias("link")).distinct()


def is_pdf(content: Column) -> Column:
    """SRC-14."""
    return F.coalesce(F.substring(content, 1, 5) == F.unhex(F.lit("255044462D")), F.lit(False))


def download_failures(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """SRC-15: reports whose last attempt failed, with stage and number of attempts."""
    last = Window.partitionBy("report_id").orderBy(F.col("attempt").desc())
    final = attempts.withColumn("_rn", F.row_number().over(last)).where("_rn = 1 and status = 'failed'").select("report_id", "stage", F.col("attempt").alias("attempts"))
    return reports.join(final, "report_id")


def analyzed(pages: DataFrame) -> DataFrame:
    """SRC-17: pages and characters of a document, and whether it needs OCR."""
    shown = F.length(F.regexp_replace("text", r"\s", ""))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), (F.sum(shown) < 50 * F.count("*")).alias("ocr_needed"))
