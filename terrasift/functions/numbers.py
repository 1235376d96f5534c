"""Localized numbers, pairs and declared areas as Column expressions.

All functions are null-safe: what is no number gives null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal ranges of the coordinates (inclusive) and units of area.
EASTING, NORTHING = (100000, 999999), (3000000, 5000000)
LATITUDE, LONGITUDE = (35, 43), (25, 46)
SQUARE_METRES_PER_HECTARE = 10000.0

#: A number inside a line: grouped by dots, commas or single blanks, or plain.
TOKEN = r"[+-]?(?:[0-9]{1,3}(?:[. ,][0-9]{3}(?![0-9]))+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"


def cleaned(value: Column) -> Column:
    """The value without blanks and colons at its ends."""
    return F.trim(F.regexp_replace(F.trim(value.cast("string")), "^:+|:+$", ""))


#: One decimal mark or none.
SINGLE = r"^[+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)$"
#: Groups of three digits behind one and the same separator, and perhaps a fraction behind the other mark.
GROUPED = r"^([+-]?[0-9]{1,3}([.,\s])[0-9]{3}(?:\2[0-9]{3})*)(?:(?!\2)[.,]([0-9]+))?$"


def parse_number(value: Column) -> Column:
    """FN-01: a localized number as a double; a single ``ddd.ddd`` group is a decimal.

    One dot or comma is the decimal mark.  A separator that repeats, a blank, or one before another
    last mark groups thousands.
    """
    text = cleaned(value)
    whole = F.regexp_replace(F.regexp_extract(text, GROUPED, 1), "[^0-9+-]", "")
    grouped = F.concat_ws(".", whole, F.nullif(F.regexp_extract(text, GROUPED, 3), F.lit("")))
    return F.when(text.rlike(SINGLE), F.translate(text, ",", ".")).otherwise(F.nullif(grouped, F.lit(""))).try_cast("double")


def number_of(token: str) -> float | None:
    """The twin of ``parse_number`` inside the document scan, by the separators between the digits."""
    text = token.strip().strip(":").strip()
    body = text[1:] if text[:1] in ("+", "-") else text
    parts, marks = [""], ""
    for c in body:
        if c in "0123456789":
            parts[-1] += c
        elif c in ".," or c.isspace():
            marks += " " if c.isspace() else c
            parts.append("")
        else:
            return None
    if not any(parts) or (marks and not parts[-1] and marks[-1] == " "):
        return None
    first = marks[:1]
    if not marks or (len(marks) == 1 and first != " "):
        value = float(".".join(parts) if marks else parts[0])
    else:
        whole = len(parts) if set(marks) == {first} else len(parts) - 1
        fraction = "0" if whole == len(parts) else parts[-1]
        if set(marks[: whole - 1]) != {first} or marks[-1] == " " != first or not fraction:
            return None
        if not 1 <= len(parts[0]) <= 3 or any(len(p) != 3 for p in parts[1:whole]):
            return None
        value = float("".join(parts[:whole]) + "." + fraction)
    return -value if text[:1] == "-" else value


def is_number(value: Column) -> Column:
    """FN-02."""
    return parse_number(value).isNotNull()


def number_tokens(line: Column) -> Column:
    """FN-03: the values of all number tokens of a line."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(f"({TOKEN})"), 1), parse_number), lambda x: x.isNotNull())


def is_easting(value: Column) -> Column:
    return F.coalesce(value.between(*EASTING), F.lit(False))


def is_northing(value: Column) -> Column:
    return F.coalesce(value.between(*NORTHING), F.lit(False))


def is_latitude(value: Column) -> Column:
    return F.coalesce(value.between(*LATITUDE), F.lit(False))


def is_longitude(value: Column) -> Column:
    return F.coalesce(value.between(*LONGITUDE), F.lit(False))


def order_utm(first: Column, second: Column) -> Column:
    """FN-08: struct(y, x) in the legal order, or null."""
    return F.when(is_easting(first) & is_northing(second), F.struct(first.alias("y"), second.alias("x"))).when(is_northing(first) & is_easting(second), F.struct(second.alias("y"), first.alias("x")))


def order_geographic(first: Column, second: Column) -> Column:
    """FN-08: struct(lat, lon); as given first, since the ranges overlap."""
    return F.when(is_latitude(first) & is_longitude(second), F.struct(first.alias("lat"), second.alias("lon"))).when(is_longitude(first) & is_latitude(second), F.struct(second.alias("lat"), first.alias("lon")))


def is_coordinate_block(y: Column, x: Column, lat: Column, lon: Column) -> Column:
    """FN-07: all four values in range."""
    return is_easting(y) & is_northing(x) & is_latitude(lat) & is_longitude(lon)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it: inside a lambda Spark shares nothing."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Runs of blank-separated tokens whose joined value is a legal coordinate, the longest first: a token of one to three
#: digits and up to three of three.  Zeros in front keep six digits an easting, and seven from 3 000 000 to 5 000 000 a northing.
_SIX, _SEVEN = "[1-9][0-9]{2} [0-9]{3}", lambda lead: f"{lead}(?:[34] [0-9]{{3}} [0-9]{{3}}|5 000 000)"
MERGED = rf"[+]?(?:0{{1,3}} (?:000 {_SIX}|{_SEVEN('00')})|{_SEVEN('0{0,2}')}|0{{1,3}} {_SIX}|{_SIX})(?=\s|$)|\S+"


def merge_thousands(tokens: Column) -> Column:
    """FN-05: rejoin blank-grouped thousands, greedily and only to legal coordinates.

    Each token either starts the longest run of up to three three-digit tokens whose value
    is legal, or stands alone: one pass of ``MERGED`` over the tokens in a line.
    """
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(MERGED), 0)


def line_tokens(line: Column) -> Column:
    """FN-06: tokens of a coordinate line: split at blanks and colons, thousands rejoined."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(line, F.lit("")), r"[\s:]+", " "), F.lit(MERGED), 0)


def values_of(tokens: Column) -> Column:
    """The numbers among tokens."""
    return F.filter(F.transform(tokens, parse_number), lambda x: x.isNotNull())


def numeric_values(line: Column) -> Column:
    return values_of(line_tokens(line))


def combined_pair(value: Column) -> Column:
    """FN-04: struct(first, second) of ``a:b`` or of exactly two numbers on a line."""
    text = F.trim(value)
    colon = r"^([+-]?[0-9][0-9.,\s]*?)\s*:\s*([+-]?[0-9][0-9.,\s]*?)$"
    by_colon = F.struct(parse_number(F.regexp_extract(text, colon, 1)).alias("first"), parse_number(F.regexp_extract(text, colon, 2)).alias("second"))
    tokens = merge_thousands(F.filter(F.split(text, r"\s+"), lambda t: (t != "") & (t != ":")))

    def by_blank(values: Column) -> Column:
        return F.when((F.size(values) == 2) & F.forall(values, lambda v: v.isNotNull()), F.struct(F.try_element_at(values, F.lit(1)).alias("first"), F.try_element_at(values, F.lit(2)).alias("second")))

    return F.when(text.rlike(colon) & by_colon["first"].isNotNull() & by_colon["second"].isNotNull(), by_colon).otherwise(bound(F.transform(tokens, parse_number), by_blank))


def recover_decimal(value: Column) -> Column:
    """FN-13: a value of a million or more whose first six digits are a legal easting."""
    digits = F.regexp_extract(value.cast("string"), r"^([0-9]{7,})$", 1)
    found = F.concat(F.substring(digits, 1, 6), F.lit("."), F.substring(digits, 7, 40)).try_cast("double")
    return F.when((F.length(digits) >= 7) & is_easting(found), found)


def canonical_decimal(value: Column) -> Column:
    """FN-16: exact plain decimal text without trailing zeros; zero is ``0``; junk is null."""
    exact = value.cast("string").try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(F.when(F.contains(exact, F.lit(".")), F.regexp_replace(exact, "0+$", "")).otherwise(exact), r"\.$", "")
    return F.when(short.isin("-0", "0", ""), F.lit("0")).otherwise(short)


def projected_token(epsg: Column, y: Column, x: Column) -> Column:
    """FN-24: ``EPSG:n|y|x``, ``CRS_UNRESOLVED|y|x``, or null unless both are finite."""
    head = F.when(epsg.isNotNull(), F.concat(F.lit("EPSG:"), epsg.cast("string"))).otherwise("CRS_UNRESOLVED")
    cy, cx = canonical_decimal(y), canonical_decimal(x)
    return F.when(cy.isNotNull() & cx.isNotNull(), F.concat_ws("|", head, cy, cx))


def area_number(token: Column, square_metres: bool) -> Column:
    """FN-17: as FN-01, but of square metres ``183.081`` is thousands."""
    text = F.regexp_replace(F.trim(token), r"\s", "")
    grouped = F.replace(text, F.lit("."), F.lit("")).try_cast("double")
    return F.when(text.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+$"), grouped).otherwise(parse_number(text)) if square_metres else parse_number(text)


_AMOUNT = r"([0-9][0-9.\s]*(?:,[0-9]+)?)"
HECTARES = rf"(?iu){_AMOUNT}\s*(?:hektar(?:lar)?|ha)(?![\p{{L}}\p{{N}}_])"
SQUARES = rf"(?iu){_AMOUNT}\s*m(?:2|²|\^2)"


def declared_hectares(text: Column) -> Column:
    """FN-18: the hectares that a caption declares; square metres are converted, totals ignored."""
    ha = area_number(F.regexp_extract(text, HECTARES, 1), False)
    m2 = area_number(F.regexp_extract(text, SQUARES, 1), True) / SQUARE_METRES_PER_HECTARE
    return F.when(text.rlike("(?iu)toplam"), None).otherwise(F.coalesce(F.when(ha > 0, ha), F.when(m2 > 0, m2)))


def declared_list(table_text: Column) -> Column:
    """FN-18: the distinct declarations (to four places) of a table's lines, in order."""
    values = F.filter(F.transform(F.split(table_text, r"\r?\n"), declared_hectares), lambda v: v.isNotNull())
    return F.array_distinct(F.transform(values, lambda v: F.round(v, 4)))


def printed_page(text: Column) -> Column:
    """FN-19: struct(compact, page) of ``12``, ``12-13`` or ``12/13``."""
    compact = F.regexp_replace(text, r"\s", "")
    return F.when(compact.rlike(r"^[0-9]+([-/][0-9]+)?$"), F.struct(compact.alias("printed"), F.regexp_extract(compact, "^([0-9]+)", 1).try_cast("int").alias("page")))
