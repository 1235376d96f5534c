"""Column functions on fixed values, each computed from the rule."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from terrasift.functions import crs, labels, numbers, text
from terrasift.operators import classify, gate


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    given = ["4.205.189,00", "463 000", "183.081", "183,081", "4,205,189.5", "12", "abc", "", None, "nan", "1_000", ": 5,5 :", "1.234,5"]
    want = [4205189.0, 463000.0, 183.081, 183.081, 4205189.5, 12.0, None, None, None, None, None, 5.5, 1234.5]
    assert values(spark, given, numbers.parse_number) == want


def test_numbers_round_trip(spark):
    rng = random.Random(5)
    cents = [rng.randrange(10**8, 10**9) for _ in range(60)]
    eu = [f"{c // 100:,}".replace(",", ".") + f",{c % 100:02d}" for c in cents]
    us = [f"{c // 100:,}.{c % 100:02d}" for c in cents]
    for written in (eu, us):
        assert [round(v * 100) for v in values(spark, written, numbers.parse_number)] == cents


def test_both_readers_of_numbers_agree(spark):
    rng = random.Random(9)
    given = ["1.2.3", "1.234.567", "1,234,567", "1.234,567", "1,234.5", "12.", ".5", ",5", ".", ",", "-1 234,5", "+12", "1 234", "1 23", "12 345 678.25", "1.234.", "1..234", "1 2,3.4", "1234.567.890", "--1", "-", "1,234,5", "1.234,567,890", "5 "]
    given += ["".join(rng.choices("0123456789", k=rng.randrange(1, 5)) + [rng.choice([".", ",", " ", ""])] + rng.choices("0123456789", k=3) + [rng.choice([".", ",", " ", ""])] + rng.choices("0123456789", k=rng.randrange(0, 4))) for _ in range(300)]
    assert values(spark, given, numbers.parse_number) == [numbers.number_of(g) for g in given]
    assert [numbers.number_of(g) for g in given[:10]] == [None, 1234567.0, 1234567.0, 1234.567, 1234.5, 12.0, 0.5, 0.5, None, None]


def test_combined_heading(spark):
    given = ["Ruhsat ve ÇED Alanı", "ÇED / Ruhsat", "Ruhsat Alanı, 12 No.lu saha ve Proje Alanı", "Ruhsat Alanı ÇED", "Ruhsat " + "x " * 9 + "ve ÇED", "Ruhsat ve", None, "Veli Ruhsat Ced"]
    assert values(spark, given, gate.is_combined) == [True, True, True, False, False, False, False, False]


def test_thousands_and_pairs(spark):
    assert values(spark, ["1 463 000 4 014 000", "R1 512300 4301200", "463 000", ""], numbers.line_tokens) == [["1", "463 000", "4 014 000"], ["R1", "512300", "4301200"], ["463 000"], []]
    got = values(spark, ["38,5 : 33,25", "512300 4301200", "1 2 3", None], numbers.combined_pair)
    assert [None if g is None else tuple(g) for g in got] == [(38.5, 33.25), (512300.0, 4301200.0), None, None]


def test_areas_and_tokens(spark):
    assert values(spark, ["183.081 m² (18,30 ha)", "183.081 m²", "Toplam Alan: 5 ha", "12 hectare", None], numbers.declared_hectares) == [18.30, pytest.approx(18.3081), None, None, None]
    assert values(spark, ["312452.230", "0.000", "-5.10", "x", "100"], numbers.canonical_decimal) == ["312452.23", "0", "-5.1", None, "100"]
    assert values(spark, ["512300123", "99"], numbers.recover_decimal) == [512300.123, None]
    assert [tuple(x) if x else None for x in values(spark, ["12", "12 - 13", "a"], numbers.printed_page)] == [("12", 12), ("12-13", 12), None]


def test_labels(spark):
    assert [None if s is None else tuple(s) for s in values(spark, ["R.12", "C1.4", "7", "abc"], labels.label_series)] == [("R", 12), ("C1", 4), ("", 7), None]
    assert values(spark, ["IR-1-3", "1-CED-2", "M2_CED-1", "1_GALERI-1", "R1"], labels.group_from_label) == ["LABEL_IR_1", "LABEL_CED_1", "LABEL_M2_CED", "LABEL_GALERI_1", None]
    assert values(spark, ["R1", "512300", "12", "35,5", None], labels.is_label) == [True, False, False, False, False]
    assert values(spark, ["12", "512300"], lambda c: labels.is_label(c, True)) == [True, False]
    assert values(spark, ["1,2", "I.3"], labels.table_no_variants) == [["1.2", "I.2"], ["I.3", "1.3"]]


def test_text(spark):
    assert values(spark, ["çığır Straße", None], text.fold) == ["CIGIR STRASSE", None]
    assert values(spark, ['a<b>:c  "d"', "...", None], text.sanitize) == ["a_b__c _d", "Bilinmiyor", "Bilinmiyor"]
    assert values(spark, ["word " * 30, "x", None, "\x01" * 100], text.usable) == [True, False, False, False]


def test_classifier(spark):
    given = ["Ruhsat Alanı Koordinatları", "Talep Edilen ÇED Alanı", "Stok Alanı (ÇED Alanı)", "Mevcut ÇED Alanı", "Galeri Ağzı", "ÇED Sınır Koordinatları", "Hiç", None]
    want = ["RUHSAT_ALANI", "YENI_CED_ALANI", "STOK_ALANI", "MEVCUT_CED_ALANI", "GALERI_ALANI", "CED_ALANI", "DIGER", "DIGER"]
    assert values(spark, given, classify.area_type) == want == [classify.area_type_of(g or "") for g in given]


def test_area_comparison(spark):
    df = spark.createDataFrame([(4.0, 4.6), (4.0, 4.61), (0.4, 0.5), (0.0, 1.0), (None, 1.0)], "d double, c double")
    got = [r["q"] for r in df.select(gate.compare_area(F.col("d"), F.col("c")).alias("q")).collect()]
    assert [None if q is None else q["match"] for q in got] == [True, False, True, None, None]


def test_projection_round_trip(spark):
    rows = [(i, 300000.0 + 1000 * i, 4000000.0 + 900 * i, 32636) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, y double, x double, e int")
    back = crs.with_utm(crs.with_wgs84(df, "y", "x", "e", "lon", "lat"), "lon", "lat", "y2", "x2")
    for r in back.collect():
        assert abs(r["y"] - r["y2"]) < 1e-3 and abs(r["x"] - r["x2"]) < 1e-3 and r["utm_zone"] == 36


def test_ed50_shift_has_the_known_size(spark):
    df = spark.createDataFrame([(512300.0, 4301200.0, 23036), (512300.0, 4301200.0, 32636), (1.0, 1.0, None)], "y double, x double, e int")
    a, b, c = crs.with_wgs84(df, "y", "x", "e", "lon", "lat").collect()
    metres = math.hypot((a["lon"] - b["lon"]) * 111320 * math.cos(math.radians(a["lat"])), (a["lat"] - b["lat"]) * 111320)
    assert 100 < metres < 300 and c["lon"] is None


def test_datum(spark):
    got = values(spark, ["Datum : ED-50\nZon : 36", "Datum : ED 50\nZon : 35\nZone 36", "WGS-84", ""], crs.datums)
    assert [(g["datum"], g["zone"], g["confidence"]) for g in got] == [("ED-50", 36, "HIGH"), ("ED-50", None, "CONFLICTING"), (None, None, "UNRESOLVED"), (None, None, "UNRESOLVED")]


def test_merged_thousands_equal_the_fold_over_tokens(spark):
    """Against the rule written out: the longest run of one token and up to three of three digits that is legal."""
    rng = random.Random(5)
    pool = ["R1", "0", "00", "000", "+0", "3", "+4", "5", "05", "003", "004", "005", "12", "99", "100", "463", "999", "-463", "+512", "001", "463,5", "4.5", "x"]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(6000)] + ["5 000 000", "5 000 001", "3 000 000", "2 999 999", "100 000", "999 999", "0 999 999"]

    def fold(tokens):
        out, i = [], 0
        while i < len(tokens):
            legal = lambda n: i + n < len(tokens) and re.fullmatch("[+-]?[0-9]{1,3}", tokens[i]) and all(re.fullmatch("[0-9]{3}", t) for t in tokens[i + 1 : i + n + 1]) and (100000 <= int("".join(tokens[i : i + n + 1])) <= 999999 or 3000000 <= int("".join(tokens[i : i + n + 1])) <= 5000000)  # noqa: B023, E731
            n = next((n for n in (3, 2, 1) if legal(n)), 0)
            out.append(" ".join(tokens[i : i + n + 1]))
            i += n + 1
        return out

    want = [fold(line.split()) for line in lines]
    assert sum(map(len, want)) < sum(len(line.split()) for line in lines)
    assert values(spark, lines, numbers.line_tokens) == want
    assert values(spark, lines, lambda c: numbers.merge_thousands(F.filter(F.split(c, " "), lambda t: t != ""))) == want


def test_line_tokens_name_their_line_once(spark):
    """A line is cut once: the plan of its tokens reads it in one place (before, it was cut again for each token)."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("line")).select(numbers.line_tokens(F.col("line")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("line#") == 2  # once read, once made
