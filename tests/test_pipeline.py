"""From page text to verdicts on small reports."""

import pytest
from pyspark.sql import functions as F

from terrasift.operators import documents, gate
from terrasift.plans import pipeline
from terrasift.sinks import kml
from terrasift.sources import corpus as sources

CRS = "Datum : ED-50\nTürü : UTM\nZon : 36\n"


def square(name, east, north, side):
    return "\n".join(f"{name}{i} {y}.00 {x}.00" for i, (y, x) in enumerate([(east, north), (east + side, north), (east + side, north + side), (east, north + side)], 1))


def report(second=True, east=512800, side=200, declared="4,00", crs=CRS, first=True, combined=False):
    head = "Ruhsat ve ÇED Alanı" if combined else "Ruhsat Alanı"
    a = f"Tablo 2. {head} Koordinatları (4,00 ha)\n{crs}{square('R', 512300, 4301200, 200)}\n" if first else ""
    b = f"Tablo 3. ÇED Alanı Koordinatları ({declared} ha)\n{crs}{square('C', east, 4301200, side)}\n" if second else ""
    return a + b


REPORTS = {
    "f1": report(),
    "f2": report(declared="0,40"),
    "f3": report(second=False),
    "f4": report(east=512300),
    "f4ok": report(east=512300, combined=True),
    "f5": report(side=8000).replace(" (4,00 ha)\n" + CRS + "C1", "\n" + CRS + "C1").replace("ÇED Alanı Koordinatları (4,00 ha)", "ÇED Alanı Koordinatları"),
    "f6": report(crs="Datum : ED-50\n").replace("Tablo 3", "Tablo 3", 1).replace("Datum : ED-50\nR1", CRS + "R1"),
    "f7": "Tablo 2. Ruhsat Alanı Koordinatları\n" + CRS + "512300\naçıklama metni burada\n512400\nbaşka bir metin\n4301200\nson metin\n4301300\n",
    "none": "Genel bilgiler\nmetin",
}


@pytest.fixture(scope="module")
def project(spark):
    rows = [(k, 1, "text_layer", v) for k, v in REPORTS.items()]
    rows += [("f8", 1, "text_layer", "Tablo 2. Ruhsat Alanı Koordinatları\n" + CRS + "\n".join(square("R", 512300, 4301200, 200).split("\n")[:2])), ("f8", 2, "text_layer", "\n".join(square("R", 512300, 4301200, 200).split("\n")[2:]))]
    return pipeline.run(spark.createDataFrame(rows, "doc_id string, page_no int, source_method string, text string"))


def by_doc(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out


def test_tables_and_points(project):
    assert sorted(by_doc(project.tables, "table_type")["f1"]) == [("CED_ALANI",), ("RUHSAT_ALANI",)]
    points = by_doc(project.points, "label", "source_page")
    assert len(points["f1"]) == 8 and sorted(points["f8"]) == [("R1", 1), ("R2", 1), ("R3", 2), ("R4", 2)]
    assert len(by_doc(project.tables, "table_type")["f8"]) == 1


def test_rings(project):
    rings = by_doc(project.rings, "table_type", "area_m2", "area_ha", "projected_crs_epsg")
    assert sorted(rings["f1"]) == [("CED_ALANI", 40000.0, 4.0, 23036), ("RUHSAT_ALANI", 40000.0, 4.0, 23036)]


def test_gate(project):
    verdict = {r["doc_id"]: (r["ok"], set(r["codes"])) for r in project.gate.collect()}
    assert verdict["f1"] == (True, set())
    assert verdict["f2"] == (False, {"AREA_MISMATCH", "EXPORT_BLOCKED"})
    assert verdict["f3"] == (False, {"MISSING_RUHSAT_OR_CED", "EXPORT_BLOCKED"})
    assert "DUPLICATE_LAYER_GEOMETRY" in verdict["f4"][1] and verdict["f4ok"][0]
    assert "CRS_AREA_INSANE" in verdict["f5"][1]


def test_diagnostics(project):
    codes = by_doc(project.diagnostics, "code")
    assert ("CRS_INHERITED",) in codes["f6"] and ("NO_COORDINATE_TABLE",) in codes["none"] and "f1" not in codes
    status = {r["doc_id"]: r["status"] for r in pipeline.status(project).collect()}
    assert status["f1"] == "BASARILI" and status["f2"] == "AREA_MISMATCH" and status["none"] == "TABLO_BULUNAMADI"


def test_never_silent(project):
    """A document with an accepted table has points or the code that says it has none."""
    tables, points = by_doc(project.tables, "table_index"), by_doc(project.points, "table_index")
    codes = by_doc(project.diagnostics, "code", "table_index")
    for doc, found in tables.items():
        for (index,) in found:
            assert (index,) in points.get(doc, []) or ("DETECTED_TABLE_NO_POINTS", index) in codes[doc]


def test_export(project, spark, tmp_path):
    kml.export(project.rings, project.gate, project.reasons, str(tmp_path))
    docs = {r["doc_id"]: r["kml"] for r in spark.read.parquet(f"{tmp_path}/kml").collect()}
    # f6 takes its code from the other table of its document and is sound otherwise
    assert set(docs) == {"f1", "f4ok", "f6"} and docs["f1"].count("<Placemark>") == 2 and "ÇED Alanı 1" in docs["f1"]
    blocked = {r["doc_id"] for r in spark.read.json(f"{tmp_path}/_Duzeltme").collect()}
    assert "f2" in blocked and "f1" not in blocked
    marks = kml.placemarks(gate.exportable(project.rings, project.gate))
    assert {(r["vertices"], r["crossings"], r["empty"]) for r in kml.scanned(marks).collect()} == {(4, 0, False)}


def test_record_layouts():
    stacked = "Tablo 4. Stok Alanı Koordinatları\nR1\n512300,50\n4301200,25\n39,1\n33,2\nR2\n512400\n4301300\n39,11\n33,21\n"
    columns = "Tablo 5. Pasa Alanı Koordinatları\nP1\nP2\nP3\n512300\n512400\n512450\n4301200\n4301300\n4301900"
    spaced = "Tablo 6. Ocak Alanı Koordinatları\n1 463 000 4 014 000\n2 463 100 4 014 000\nR3 463 100 4 014 200"
    read = lambda t: [(p["label"], p["utm_y"], p["utm_x"], p["latitude"], p["longitude"]) for p in documents.scan_document([(1, "ocr", t)])[1]]
    assert read(stacked) == [("R1", 512300.5, 4301200.25, 39.1, 33.2), ("R2", 512400.0, 4301300.0, 39.11, 33.21)]
    assert read(columns) == [("P1", 512300.0, 4301200.0, None, None), ("P2", 512400.0, 4301300.0, None, None), ("P3", 512450.0, 4301900.0, None, None)]
    assert [(y, x) for _, y, x, _, _ in read(spaced)] == [(463000.0, 4014000.0), (463100.0, 4014000.0), (463100.0, 4014200.0)]


def test_marked_text(spark):
    docs = spark.createDataFrame([("a", "--- Sayfa 3 [PDF METİN KATMANI] ---\nx\ny\n--- Sayfa 4 [OCR] ---\nz\n--- Sayfa 5 [??] ---\nw"), ("b", None)], "doc_id string, text string")
    got = [(r["page_no"], r["source_method"], r["text"]) for r in sources.lines(docs).where("doc_id = 'a'").orderBy("line_no").collect()]
    assert got == [(3, "text_layer", "x"), (3, "text_layer", "y"), (4, "ocr", "z"), (None, None, "w")]


def test_empty_input(spark):
    none = spark.createDataFrame([], "doc_id string, page_no int, source_method string, text string")
    out = pipeline.run(none)
    assert out.gate.count() == 0 and out.rings.where(F.lit(True)).count() == 0
