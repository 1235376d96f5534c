"""Map scaling, field snapshots and the plain number finder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.numbers import is_easting, is_northing

WIDTH, HEIGHT = 850, 600


def on_canvas(vertices: DataFrame, lon: str = "lon", lat: str = "lat", keys: tuple[str, ...] = ()) -> DataFrame:
    """API-03: linear positions on the canvas between the least and the largest coordinates of each key."""
    whole = Window.partitionBy(*keys)
    part = lambda c: F.coalesce((F.col(c) - F.min(c).over(whole)) / F.nullif(F.max(c).over(whole) - F.min(c).over(whole), F.lit(0)), F.lit(0.5))
    return vertices.withColumns({"canvas_x": part(lon) * WIDTH, "canvas_y": (1 - part(lat)) * HEIGHT})


def layers(rings: DataFrame) -> DataFrame:
    """API-03: the distinct layers in first-seen order."""
    return rings.groupBy("doc_id", "table_type").agg(F.min("first_seq").alias("first_seq"))


def snapshot(df: DataFrame, fields: list[str]) -> DataFrame:
    """FN-25: JSON text of the present fields only; null fields are left out."""
    present = [c for c in fields if c in df.columns]
    return df.withColumn("snapshot", F.to_json(F.struct(*[F.col(c) for c in present])))


def adjacent_pairs(text: Column) -> Column:
    """FN-26: adjacent numbers of five to eight digits that are a legal pair, of the slice up to the total."""
    body = F.split(F.substring(text, 1, 5000), r"(?iu)TOPLAM ALAN")[0]
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"(?<![0-9])([0-9]{5,8}(?:[.,][0-9]+)?)(?![0-9])"), 1), lambda x: F.translate(x, ",", ".").cast("double"))
    pairs = F.zip_with(numbers, F.slice(numbers, 2, 100_000), lambda a, b: F.struct(a.alias("y"), b.alias("x")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & is_easting(p["y"]) & is_northing(p["x"]))


def joined_fragments(tokens: Column, start: Column) -> Column:
    """FN-14: up to three consecutive digit fragments from a place joined to a legal coordinate, longest first."""
    def joined(n: int) -> Column:
        parts = F.slice(tokens, start, F.lit(n))
        value = F.array_join(parts, "").try_cast("double")
        fits = (F.size(parts) == n) & F.forall(parts, lambda p: p.rlike(r"^[0-9]+([.,][0-9]+)?$"))
        return F.when(fits & (is_easting(value) | is_northing(value)), F.struct(value.alias("value"), F.lit(n).alias("used")))

    return F.coalesce(joined(3), joined(2), joined(1))


def recovered_row(values: Column) -> Column:
    """PAR-03: the first easting with a northing after it, and the first latitude and longitude after these."""
    n = F.size(values)
    at = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    y = F.try_element_at(F.filter(at, lambda p: is_easting(p["v"])), F.lit(1))
    x = F.try_element_at(F.filter(at, lambda p: is_northing(p["v"]) & (p["i"] > y["i"])), F.lit(1))
    lat = F.try_element_at(F.filter(at, lambda p: p["v"].between(35, 43) & (p["i"] > x["i"])), F.lit(1))
    lon = F.try_element_at(F.filter(at, lambda p: p["v"].between(25, 46) & (p["i"] > lat["i"])), F.lit(1))
    return F.when((n >= 4) & lon.isNotNull(), F.struct(y["v"].alias("y"), x["v"].alias("x"), lat["v"].alias("lat"), lon["v"].alias("lon")))
