from pyspark.sql import functions as F

from terrasift.operators import display


def one(spark, schema, value, expr):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


def test_pairs_and_rows(spark):
    got = one(spark, "v string", "512300 4301200 12 512400.5 4301300 TOPLAM ALAN 512500 4301400", display.adjacent_pairs)
    assert [tuple(p) for p in got] == [(512300.0, 4301200.0), (512400.5, 4301300.0)]
    row = one(spark, "v array<double>", [7.0, 512300.0, 4301200.0, 38.5, 33.2], display.recovered_row)
    assert tuple(row) == (512300.0, 4301200.0, 38.5, 33.2)
    assert one(spark, "v array<double>", [512300.0, 4301200.0], display.recovered_row) is None
    got = one(spark, "v array<string>", ["512", "300", "x"], lambda v: display.joined_fragments(v, F.lit(1)))
    assert (got["value"], got["used"]) == (512300.0, 2)


def test_canvas(spark):
    df = spark.createDataFrame([(30.0, 38.0), (32.0, 39.0), (31.0, 38.5)], "lon double, lat double")
    got = {(r["lon"]): (r["canvas_x"], r["canvas_y"]) for r in display.on_canvas(df).collect()}
    assert got == {30.0: (0.0, 600.0), 32.0: (850.0, 0.0), 31.0: (425.0, 300.0)}


def test_snapshot(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert display.snapshot(df, ["a", "b", "c"]).first()["snapshot"] == '{"a":1}'
