"""Gated KML export, quarantine, scan-back and table writers.

The gate is computed for all documents first; rings reach a writer only through a
semi-join on passing documents, and Spark's commit protocol leaves no partial output.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators import gate
from terrasift.operators.rings import crossing_pairs, lonlat_parts


def escaped(text: Column) -> Column:
    """XML entities; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_table(pairs: list[tuple[str, Column]]) -> Column:
    """SNK-04: a two-column table of names and values, empty values left out."""
    rows = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"<tr><td>{n}</td><td>"), escaped(v), F.lit("</td></tr>"))) for n, v in pairs]
    return F.concat(F.lit("<table>"), F.concat_ws("", *rows), F.lit("</table>"))


def placemarks(rings: DataFrame) -> DataFrame:
    """SNK-02..04: one placemark text per ring part, numbered within its document and type;
    a number at the end of the group's name overrides the serial."""
    named = lonlat_parts(rings).join(F.broadcast(gate.display_names(rings.sparkSession)), "table_type", "left")
    from pyspark.sql import Window

    serial = F.row_number().over(Window.partitionBy("doc_id", "table_type").orderBy("first_seq", "part_no", "kml_part"))
    own = F.nullif(F.regexp_extract("polygon_group", r"([0-9]+)$", 1), F.lit(""))
    name = F.concat_ws(" ", F.coalesce("display", F.initcap(F.replace("table_type", F.lit("_"), F.lit(" ")))), F.coalesce(own, serial.cast("string")))
    body = html_table([("Alan (ha)", F.col("area_ha")), ("Beyan (ha)", F.col("declared_ha")), ("EPSG", F.col("projected_crs_epsg"))])
    mark = F.concat(F.lit("<Placemark><name>"), escaped(F.col("_name")), F.lit("</name><description>"), escaped(body), F.lit("</description><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.col("coordinates"), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    numbered = named.withColumn("_name", name)
    return numbered.select("doc_id", "table_type", "first_seq", "part_no", "kml_part", F.col("_name").alias("name"), "coordinates", mark.alias("placemark"))


def documents(marks: DataFrame) -> DataFrame:
    """SNK-01, SNK-02: one KML text per document, a folder for each type in first-seen order."""
    folder = marks.groupBy("doc_id", "table_type").agg(F.min("first_seq").alias("_f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "part_no", "kml_part", "placemark"))), lambda s: s["placemark"]), "").alias("_m"))
    text = F.concat(F.lit("<Folder><name>"), F.col("table_type"), F.lit("</name>"), F.col("_m"), F.lit("</Folder>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_f", "table_type", text.alias("t")))), lambda s: s["t"]), "")
    return folder.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), joined, F.lit("</Document></kml>")).alias("kml"))


def export(rings: DataFrame, verdicts: DataFrame, reasons: DataFrame, target: str) -> None:
    """SNK-01, SNK-05: KML texts of passing documents and reasons of the others, as two datasets."""
    documents(placemarks(gate.exportable(rings, verdicts))).write.mode("overwrite").parquet(f"{target}/kml")
    quarantine(verdicts, reasons).write.mode("overwrite").json(f"{target}/_Duzeltme")


def write_files(texts: DataFrame, names: DataFrame, target: str) -> DataFrame:
    """SNK-01: one ``.kml`` file for each document under a folder that all executors share, at its path in
    ``names`` (doc_id, path); a file appears whole or not at all.  Returns (doc_id, path, bytes) as written."""

    def run(batches):
        for batch in batches:
            sizes = []
            for path, text in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                file = os.path.join(target, *[p for p in path.split("/") if p not in ("", ".", "..")])
                os.makedirs(os.path.dirname(file), exist_ok=True)
                part = f"{file}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8") as out:
                    sizes.append(out.write(text))
                    out.flush()
                    os.fsync(out.fileno())
                os.replace(part, file)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "path", "chars"])

    return texts.join(names, "doc_id").select("doc_id", "path", "kml").mapInArrow(run, "doc_id string, path string, chars long")


def quarantine(verdicts: DataFrame, reasons: DataFrame) -> DataFrame:
    """SNK-05: what blocks each document, with a message."""
    rows = reasons.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("code", "table_title", "table_type"))).alias("reasons"))
    message = F.concat_ws("; ", F.transform("reasons", lambda r: F.concat_ws(" ", r["code"], r["table_title"])))
    return verdicts.where("not ok").join(rows, "doc_id", "left").withColumn("message", message)


def scanned(marks: DataFrame) -> DataFrame:
    """SNK-06: vertices and crossings read back from coordinate texts; empty and crossed rings flagged."""
    pairs = F.transform(F.filter(F.split("coordinates", " "), lambda t: t != ""), lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("y"), F.split(t, ",")[1].cast("double").alias("x")))
    keyed = marks.select(F.concat_ws("|", "doc_id", "table_type", F.col("first_seq").cast("string"), F.col("part_no").cast("string"), F.col("kml_part").cast("string")).alias("ring_id"), pairs.alias("p"))
    rows = keyed.select("ring_id", F.posexplode("p").alias("i", "v"), F.size("p").alias("n")).where("i < n - 1")
    ends = keyed.select("ring_id", "p", (F.size("p") - 1).alias("n"))
    edges = rows.drop("n").join(ends, "ring_id").select("ring_id", "i", "n", F.col("v.y").alias("y1"), F.col("v.x").alias("x1"), F.element_at("p", F.col("i") + 2)["y"].alias("y2"), F.element_at("p", F.col("i") + 2)["x"].alias("x2"))
    crossed = crossing_pairs(edges).groupBy("ring_id").agg(F.count("*").alias("crossings"))
    return ends.select("ring_id", F.col("n").alias("vertices")).join(crossed, "ring_id", "left").na.fill(0, ["crossings"]).withColumn("empty", F.col("vertices") < 3)


def table(df: DataFrame, path: str, kind: str = "json", append: bool = False) -> None:
    """SNK-07..09: JSON lines or CSV by the commit protocol, new or appended; arrays and structs become
    JSON text in CSV."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    writer = (df.select(*flat) if kind == "csv" else df).write.mode("append" if append else "overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def report(results: DataFrame) -> DataFrame:
    """SNK-09: counts by province and status."""
    return results.groupBy("province", "status").agg(F.count("*").alias("n"))
