"""From pages to verdicts: the whole chain as one plan over a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import documents, gate, metadata, points, rings
from terrasift.operators.classify import inherited, prioritised
from terrasift.session import stored


@dataclass
class Project:
    """API-01: the tables of a corpus after the chain."""

    documents: DataFrame
    tables: DataFrame
    points: DataFrame
    rings: DataFrame
    reasons: DataFrame
    gate: DataFrame
    diagnostics: DataFrame

    def counts(self) -> DataFrame:
        """Tables, points and rings of each document."""
        n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
        out = self.documents.select("doc_id")
        for df, name in ((self.tables, "tables"), (self.points, "points"), (self.rings, "rings")):
            out = out.join(n(df, name), "doc_id", "left")
        return out.na.fill(0)


def run(pages: DataFrame, paths: DataFrame | None = None, scopes: DataFrame | None = None) -> Project:
    """ORC-01, ORC-05: every stage over every document of the pages table.

    One shuffle by document feeds the scan, which runs once; later keys all begin with doc_id.
    What several stages read is written to the shared folder.  ``scopes`` (page, y, x, area_type)
    are the merged cells of page layouts, whose types go before those of the headings.
    """
    pages = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    scan = stored(documents.scanned(pages))
    found = stored(points.observation_identity(points.table_crs(prioritised(inherited(documents.tables(scan))))))
    parsed = points.attested(points.transformed(documents.points(scan), found))
    unique = points.first_of(parsed, ["doc_id", "table_index", "polygon_group", "label", "utm_y", "utm_x", "latitude", "longitude"], ["seq"])
    typed = unique if scopes is None else points.scoped_types(unique, scopes)
    marked = stored(points.with_declared(points.with_conflicts(typed)))
    built = stored(gate.annotated(rings.build(marked)))
    cover = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "\n").alias("text"))
    meta = metadata.extract(cover.withColumn("path", F.lit(None).cast("string")) if paths is None else cover.join(paths, "doc_id", "left"))
    why = gate.reasons(built, meta)
    return Project(meta, found, marked, built, why, gate.verdicts(why, meta), gate.diagnostics(meta, found, marked, built))


def status(project: Project) -> DataFrame:
    """ORC-05: the batch status of each document: the first stage that gave nothing, else the first
    blocking code, else BASARILI."""
    counted = project.counts().join(project.gate, "doc_id", "left")
    blocked = F.try_element_at(F.filter("codes", lambda c: c != "EXPORT_BLOCKED"), F.lit(1))
    kind = F.when(F.col("tables") == 0, "TABLO_BULUNAMADI").when(F.col("points") == 0, "TABLO_VAR_KOORDINAT_YOK").when(F.col("rings") == 0, "KOORDINAT_VAR_POLYGON_YOK").when(~F.col("ok"), blocked).otherwise("BASARILI")
    return counted.select("doc_id", "tables", "points", "rings", kind.alias("status"))
