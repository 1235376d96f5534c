"""The scan on awkward pages, and what stands around the plan: runs, files, ladder steps, command line."""

import math
import random

from pyspark.sql import functions as F

from terrasift import __main__ as cli
from terrasift.operators import corpus, documents
from terrasift.plans import benchmark
from terrasift.sinks import kml

HEAD = "Datum : ED-50\nTürü : UTM\nZon : 36\n"


def ring(name, east, side=200, first=1):
    return "\n".join(f"{name}{i} {y}.00 {x}.00" for i, (y, x) in enumerate([(east, 4301200), (east + side, 4301205), (east + side + 5, 4301200 + side), (east + 3, 4301195 + side)], first))


def read(*pages):
    tables, points = documents.scan_document([(k, "text_layer", t) for k, t in enumerate(pages, 1)])
    return [(t["table_index"], t["table_type"]) for t in tables], points


def test_late_caption_takes_the_ring_before_it():
    tables, points = read(f"Tablo 4. Stok Alanı Koordinatları\n{HEAD}{ring('S', 512300)}\n{ring('C', 516000)}\nTablo 5. ÇED Alanı Koordinatları\n{HEAD}")
    assert tables == [(1, "STOK_ALANI"), (2, "CED_ALANI")]
    assert [(p["table_index"], p["label"]) for p in points] == [(1, f"S{i}") for i in range(1, 5)] + [(2, f"C{i}") for i in range(1, 5)]


def test_one_series_of_two_sizes_is_split_by_size():
    turn = [(round(512300 + 40 * math.cos(i * math.pi / 5), 2), round(4301200 + 40 * math.sin(i * math.pi / 5), 2)) for i in range(10)]
    small, large = "\n".join(f"{i} {y} {x}" for i, (y, x) in enumerate(turn, 1)), ring("", 516000, 900, first=11)
    tables, points = read(f"Tablo 4. Stok Alanı Koordinatları\n{HEAD}{small}\n{large}\nTablo 5. ÇED Alanı Koordinatları\n{HEAD}")
    assert tables == [(1, "STOK_ALANI"), (2, "CED_ALANI")] and [p["table_index"] for p in points] == [1] * 10 + [2] * 4


def test_same_types_and_short_rings_are_not_split():
    one = f"Tablo 4. Stok Alanı Koordinatları\n{HEAD}{ring('S', 512300)}\n{ring('C', 516000)}\nTablo 5. Stok Alanı Koordinatları\n{HEAD}{ring('D', 518000)}"
    assert [p["table_index"] for p in read(one)[1]] == [1] * 8 + [2] * 4


def test_pages_go_on_or_belong_to_the_caption_below():
    first = f"Tablo 4. Stok Alanı Koordinatları\n{HEAD}{ring('S', 512300)}"
    assert [p["table_index"] for p in read(first, ring("S", 518000, first=5))[1]] == [1] * 8
    tables, points = read(first, f"{ring('C', 516000)}\nTablo 5. ÇED Alanı Koordinatları\n{HEAD}")
    assert tables == [(1, "STOK_ALANI"), (2, "CED_ALANI")] and [p["source_page"] for p in points] == [1] * 4 + [2] * 4
    assert [p["table_index"] for p in read(first, f"{ring('S', 516000, first=5)}\nTablo 5. ÇED Alanı Koordinatları\n{HEAD}{ring('C', 519000)}")[1]] == [1] * 8 + [2] * 4


def test_rows_before_any_caption_and_appendix_scope():
    assert read(f"{HEAD}{ring('S', 512300)}\nTablo 6. Pasa Alanı Koordinatları")[0] == [(1, "PASA_ALANI")]
    whole = f"Tablo 1. Ocak Alanı Koordinatları\n{HEAD}{ring('O', 512300)}\nEK-1 SEÇİLEN YERİN KOORDİNATLARI\nTablo 2. ÇED Alanı Koordinatları\n{HEAD}{ring('C', 516000)}\nKAYNAKÇA\nson"
    assert read(whole)[0] == [(1, "CED_ALANI")]


def test_degrees_after_an_auxiliary_table_are_the_projects():
    _, points = read(f"Tablo 8. Stok Alanı Koordinatları\n{HEAD}{ring('S', 512300)}\n39,11 33,21\n39,12 33,22\n39,13 33,23")
    assert [p["table_type"] for p in points] == ["STOK_ALANI"] * 4 + ["CED_ALANI"] * 3
    assert points[-1]["latitude"] == 39.13 and points[-1]["utm_y"] is None


def test_record_layouts_mix_in_one_table():
    body = "R1 512300 4301200\nR2\n512400\n4301210\n39,1\n33,2\n3 39,11\n512410 4301300 33,21\nR4 512 420 430 1310 39,12 33,22"
    _, points = read(f"Tablo 2. Ruhsat Alanı Koordinatları\n{HEAD}{body}")
    assert [(p["label"], p["utm_y"], p["utm_x"], p["latitude"], p["parser_method"]) for p in points] == [
        ("R1", 512300.0, 4301200.0, None, "row"),
        ("R2", 512400.0, 4301210.0, 39.1, "stacked"),
        ("3", 512410.0, 4301300.0, 39.11, "stitched"),
        ("R4", 512420.0, 4301310.0, 39.12, "recovered"),
    ]


def test_false_degrees_reject_a_stacked_record():
    _, points = read(f"Tablo 2. Ruhsat Alanı Koordinatları\n{HEAD}{ring('R', 512300)}\nR9\n512900\n4301900\n390,1\n33,2")
    assert [p["label"] for p in points] == ["R1", "R2", "R3", "R4"]


def test_random_text_never_fails():
    rng = random.Random(4)
    pieces = ["Tablo 4.", "Stok Alanı", "Koordinatları", "512300", "4301200", "39,1", "R1", ":", "\n", " ", "ÇED", "EK-1", "KAYNAKÇA", "1 234", "--- Sayfa 1 [OCR] ---", "½", "\x00", "Toplam Alan: 5 ha", "2.1. Giriş"]
    for _ in range(150):
        tables, points = documents.scan_document([(None if rng.random() < 0.2 else k, None, "".join(rng.choices(pieces, k=rng.randrange(0, 80))) if rng.random() > 0.1 else None) for k in range(rng.randrange(0, 4))])
        assert all(p["table_index"] <= len(tables) for p in points)


def test_table_texts_are_found_in_order():
    lines = documents.lines_of([(1, "t", "a\nb\nc\na\nb\nd")])
    assert documents.match_lines(lines, ["a\nb", "a\nb", "x", "d"]) == [(0, 2), (3, 5), None, (5, 6)]


def test_runs_resume_and_keep_what_is_there(spark, tmp_path):
    records = spark.createDataFrame([(f"{i}.pdf", i, i) for i in range(6)], "path string, size long, mtime long")
    process = lambda df: df.select("*", F.lit("BASARILI").alias("status"), F.lit(1).alias("polygons"), (F.col("size") > 2).alias("fallback_used"))
    target = str(tmp_path / "runs")
    assert benchmark.run(records.where("size < 4"), process, target, "a").count() == 4
    assert benchmark.run(records, process, target, "b").count() == 2
    assert sorted(r["size"] for r in spark.read.parquet(target).collect()) == list(range(6))
    top = benchmark.summary(spark.read.parquet(target), ["run_id"]).where("grouping = 1").first()
    assert (top["documents"], top["usable"], top["quick"]) == (6, 6, 3)


def test_files_are_written_whole(spark, tmp_path):
    texts = spark.createDataFrame([("a", "<kml>ş</kml>"), ("b", "<kml/>")], "doc_id string, kml string")
    names = spark.createDataFrame([("a", "Adana/Ek-1/x.kml"), ("b", "../../b.kml")], "doc_id string, path string")
    assert {r["doc_id"] for r in kml.write_files(texts, names, str(tmp_path)).collect()} == {"a", "b"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["Adana/Ek-1/x.kml", "b.kml"]
    assert (tmp_path / "Adana/Ek-1/x.kml").read_text(encoding="utf-8") == "<kml>ş</kml>"


def test_appended_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"])], "a int, b array<string>")
    for _ in range(2):
        kml.table(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_numbered_and_systematic(spark):
    df = spark.createDataFrame([(i * 7919 % 1009, i % 5) for i in range(1009)], "k long, part int").repartition(5)
    got = sorted((r["k"], r["row_no"]) for r in corpus.numbered(df, ["k"]).collect())
    assert got == [(i, i) for i in range(1009)]
    assert sorted(r["k"] for r in corpus.systematic(df, 10, ["k"]).collect()) == [100 * i for i in range(10)]


def test_command_line(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "text_layer", f"Tablo 2. Ruhsat Alanı Koordinatları\n{HEAD}{ring('R', 512300)}")], "doc_id string, page_no int, source_method string, text string")
    pages.write.parquet(f"{tmp_path}/pages")
    assert cli.main(["failures", f"{tmp_path}/pages", f"{tmp_path}/out"], spark) == 0
    assert [(r["finding"], r["points"]) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("OK", 4)]
    assert cli.main(["plan", f"{tmp_path}/pages", f"{tmp_path}/plan"], spark) == 0


def test_documents_are_scanned_whole_across_batches(spark):
    """A plan without a Python call for each document; one whose pages lie in several batches is read as one."""
    pages = [(d, p, "text_layer", text) for d in "abc" for p, text in ((2, ring("S", 516000, first=5)), (1, f"Tablo 4. Stok Alanı Koordinatları\n{HEAD}{ring('S', 512300)}"))]
    df = spark.createDataFrame([*pages, (None, 1, "ocr", pages[1][3]), ("z", None, "ocr", None)], "doc_id string, page_no int, source_method string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        scan = documents.scanned(df)
        assert "FlatMapGroupsInArrow" not in scan._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(((r["doc_id"] or ""), r["table_index"], r["first_page"], r["last_page"], [p["label"] for p in r["points"]]) for r in scan.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = [f"S{i}" for i in range(1, 9)]
    assert got == [("", 1, 1, 1, names[:4]), *[(d, 1, 1, 2, names) for d in "abc"]]
