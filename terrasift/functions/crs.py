"""Datums, zones and the transverse Mercator projection as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoids (axis, flattening) and the shift of ED50 to WGS84 (position vector).
INTERNATIONAL, WGS84 = (6378388.0, 1 / 297.0), (6378137.0, 1 / 298.257223563)
ED50_SHIFT = (-84.1, -101.8, -129.7)
ED50_TURN_RZ, ED50_SCALE = 0.468, 1.05e-6
SCALE, FALSE_EASTING = 0.9996, 500000.0


def datums(text: Column) -> Column:
    """CRS-01: struct of datum, zone, dom, projection, confidence and conflict reasons of a table's text."""
    upper = F.upper(text)
    ed50 = upper.rlike(r"ED[\s\-]?\s?50|EUROPEAN DATUM")
    wgs84 = upper.rlike(r"WGS[\s\-]?\s?84")
    numbers = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(upper, F.lit(p), 1), lambda x: x.cast("int"))))
    zones = numbers(r"(?:ZON|ZONE|D[İI]L[İI]M)[^0-9\n]{0,12}(3[5-9])(?![0-9])")
    doms = numbers(r"(?:D\.?O\.?M\.?|ORTA MER[İI]DYEN)[^0-9\n]{0,12}(2[7]|3[0369]|4[25])(?![0-9])")
    three, six = upper.rlike(r"3\s?(?:°|DERECE)"), upper.rlike(r"6\s?(?:°|DERECE)")
    reasons = F.array_compact(F.array(F.when(F.size(zones) > 1, "ZONE_CONFLICT"), F.when(F.size(doms) > 1, "DOM_CONFLICT"), F.when(three & six, "PROJECTION_CONFLICT")))
    high = ed50 & (F.size(zones) == 1) & (F.size(reasons) == 0)
    return F.struct(
        F.when(ed50, "ED-50").alias("datum"),
        F.when(wgs84, "WGS-84").alias("geographic_datum"),
        F.when(F.size(zones) == 1, F.element_at(zones, 1)).alias("zone"),
        F.when(F.size(doms) == 1, F.element_at(doms, 1)).alias("dom"),
        F.when(three & ~six, 3).when(six & ~three, 6).alias("projection"),
        F.when(F.size(reasons) > 0, "CONFLICTING").when(high, "HIGH").otherwise("UNRESOLVED").alias("confidence"),
        F.array_join(reasons, "|").alias("reasons"),
    )


def epsg_of(datum: Column, zone: Column, projection: Column | None = None) -> Column:
    """CRS-02: ED50 / UTM zone N is 23000 + N, WGS84 / UTM is 32600 + N; else null."""
    code = F.when(zone.between(1, 60) & (datum == "ED-50"), 23000 + zone).when(zone.between(1, 60) & (datum == "WGS-84"), 32600 + zone)
    return code if projection is None else F.when(F.coalesce(projection, F.lit(6)) != 3, code)


def zone_from_dom(dom: Column) -> Column:
    """CRS-04: the six-degree zone of a central meridian."""
    return F.when(dom == 27, 35).when(dom == 33, 36).when(dom == 39, 37)


def zone_of(epsg: Column) -> Column:
    return F.when(epsg.between(23028, 23038), epsg - 23000).when(epsg.between(32601, 32660), epsg - 32600)


def _series(f: float) -> tuple[float, tuple, tuple, tuple]:
    """Rectifying factor, forward and inverse Krueger series and the latitude series of a flattening."""
    n = f / (2 - f)
    a = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return a, alpha, beta, latitude


def _staged(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Columns in steps: each is computed once, however often later ones use it."""
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*[c for step in steps for c in step if c.startswith("_")])


def with_wgs84(df: DataFrame, y: str, x: str, epsg: str, lon: str = "transformed_longitude", lat: str = "transformed_latitude") -> DataFrame:
    """CRS-03: longitude and latitude in degrees of easting y and northing x; null for an unknown code.

    Inverse transverse Mercator on the code's ellipsoid; ED50 then goes through geocentric
    coordinates by the seven-parameter shift.
    """
    c = F.col
    old = c("_old")
    pick = lambda i, w: F.when(old, F.lit(float(i))).otherwise(F.lit(float(w)))
    (ia, _, ib, il), (wa, _, wb, wl) = _series(INTERNATIONAL[1]), _series(WGS84[1])
    radius = pick(SCALE * INTERNATIONAL[0] * ia, SCALE * WGS84[0] * wa)
    e2, (axis, flat) = INTERNATIONAL[1] * (2 - INTERNATIONAL[1]), WGS84
    rz, m, minor, e2w = ED50_TURN_RZ / 3600 * pi / 180, 1 + ED50_SCALE, axis * (1 - flat), flat * (2 - flat)
    sin_sum = lambda trig, hyper, base: base - sum((pick(i, w) * trig(2 * (k + 1) * c("_xi")) * hyper(2 * (k + 1) * c("_eta")) for k, (i, w) in enumerate(zip(ib, wb, strict=True))), F.lit(0.0))
    return _staged(
        df,
        {"_zone": zone_of(c(epsg)).cast("double"), "_old": F.coalesce(c(epsg).between(23028, 23038), F.lit(False))},
        {"_xi": c(x) / radius, "_eta": (c(y) - FALSE_EASTING) / radius},
        {"_xp": sin_sum(F.sin, F.cosh, c("_xi")), "_ep": sin_sum(F.cos, F.sinh, c("_eta"))},
        {"_chi": F.asin(F.sin("_xp") / F.cosh("_ep")), "_l": F.atan2(F.sinh("_ep"), F.cos("_xp")) + (c("_zone") * 6 - 183) * (pi / 180)},
        {"_b": c("_chi") + sum((pick(i, w) * F.sin(2 * (k + 1) * c("_chi")) for k, (i, w) in enumerate(zip(il, wl, strict=True))), F.lit(0.0))},
        {"_v": INTERNATIONAL[0] / F.sqrt(1 - e2 * F.sin("_b") * F.sin("_b"))},
        {"_gx": c("_v") * F.cos("_b") * F.cos("_l"), "_gy": c("_v") * F.cos("_b") * F.sin("_l"), "_gz": c("_v") * (1 - e2) * F.sin("_b")},
        {"_px": ED50_SHIFT[0] + m * (c("_gx") - rz * c("_gy")), "_py": ED50_SHIFT[1] + m * (rz * c("_gx") + c("_gy")), "_pz": ED50_SHIFT[2] + m * c("_gz")},
        {"_p": F.sqrt(c("_px") * c("_px") + c("_py") * c("_py"))},
        {"_t": F.atan2(c("_pz") * axis, c("_p") * minor)},
        {
            lon: F.degrees(F.when(old, F.atan2("_py", "_px")).otherwise(c("_l"))),
            lat: F.degrees(F.when(old, F.atan2(c("_pz") + (axis * axis - minor * minor) / minor * F.pow(F.sin("_t"), F.lit(3)), c("_p") - e2w * axis * F.pow(F.cos("_t"), F.lit(3)))).otherwise(c("_b"))),
        },
    )


def with_utm(df: DataFrame, lon: str, lat: str, y: str = "utm_y", x: str = "utm_x", zone: str = "utm_zone") -> DataFrame:
    """CRS-07: easting, northing and zone on WGS84 of degrees, in the zone of the longitude."""
    c = F.col
    a, alpha, _, _ = _series(WGS84[1])
    e = (WGS84[1] * (2 - WGS84[1])) ** 0.5
    radius = SCALE * WGS84[0] * a
    more = lambda trig, hyper, base: base + sum((k * trig(2 * (i + 1) * c("_xi")) * hyper(2 * (i + 1) * c("_eta")) for i, k in enumerate(alpha)), F.lit(0.0))
    return _staged(
        df,
        {zone: (F.floor((c(lon) + 180) / 6) + 1).cast("int"), "_s": F.sin(F.radians(lat))},
        {"_t": F.sinh(F.atanh("_s") - e * F.atanh(e * c("_s"))), "_d": F.radians(c(lon) - (c(zone) * 6 - 183))},
        {"_xi": F.atan2(c("_t"), F.cos("_d")), "_eta": F.atanh(F.sin("_d") / F.sqrt(1 + c("_t") * c("_t")))},
        {y: FALSE_EASTING + radius * more(F.cos, F.sinh, c("_eta")), x: radius * more(F.sin, F.cosh, c("_xi"))},
    )
