"""Point labels and table numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.numbers import is_easting, is_northing, parse_number

LABEL = r"^(?=.*[\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}_.\-/()]{0,24}$"
NUMERIC_LABEL = r"^[0-9]{1,4}$"


def is_label(value: Column, numeric: Column | bool = False) -> Column:
    """FN-09: whether a token may name a point; numbers only by context and never coordinates."""
    text, allow = F.trim(value), F.lit(numeric) if isinstance(numeric, bool) else numeric
    number = parse_number(text)
    legal = is_easting(number) | is_northing(number)
    as_number = F.when(legal | number.between(25, 46), False).otherwise(allow & (number < 1000))
    found = F.when(F.coalesce(text, F.lit("")) == "", False).when(allow & text.rlike(NUMERIC_LABEL), ~legal).when(~text.rlike(LABEL), False).when(number.isNotNull(), as_number).otherwise(True)
    return F.coalesce(found, F.lit(False))


def normalize_label(label: Column) -> Column:
    """FN-10: upper case, single blanks, OCR confusions of I and 1 undone, parts joined by ``_``."""
    text = F.regexp_replace(F.upper(F.trim(label)), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, "-[Iİ]-", "-1-"), "-[Iİ]$", "-1")
    text = F.regexp_replace(text, "GALER[L1I](?![A-Z])", "GALERI")
    text = F.regexp_replace(text, r"^([A-Z]+[0-9]*) (CED|GALERI)", "$1_$2")
    text = F.regexp_replace(text, r"^([0-9]+) (GALERI|CED)", "$1_$2")
    return F.regexp_replace(text, r"^([A-Z]+) ([0-9]+)$", "$1-$2")


def label_series(label: Column) -> Column:
    """FN-11: struct(stem, number): ``R.12`` is (R, 12), ``C1.4`` is (C1, 4), ``7`` is ('', 7)."""
    text = F.upper(F.trim(label))
    stem, tail = r"^([\p{L}_]+[0-9]*?)[.\-_ ]?([0-9]+)$", r"^([\p{L}][\p{L}0-9_]*)[.\-_ ]([0-9]+)$"
    pick = lambda p: F.struct(F.regexp_extract(text, p, 1).alias("stem"), F.regexp_extract(text, p, 2).try_cast("int").alias("number"))
    bare = F.struct(F.lit("").alias("stem"), text.try_cast("int").alias("number"))
    return F.when(text.rlike(tail), pick(tail)).when(text.rlike(stem), pick(stem)).when(text.rlike(r"^[0-9]+$"), bare)


def group_from_label(label: Column) -> Column:
    """FN-12: the polygon group that a label names, or null."""
    text = normalize_label(label)
    cases = (
        (r"^([A-Z]+)-([0-9]+)-[0-9]+$", ("LABEL_", 1, "_", 2)),
        (r"^([0-9]+)-(CED|GALERI)-[0-9]+$", ("LABEL_", 2, "_", 1)),
        (r"^([A-Z]+[0-9]+)_(CED|GALERI)-[0-9]+$", ("LABEL_", 1, "_", 2)),
        (r"^([0-9]+)_(GALERI|CED)-[0-9]+$", ("LABEL_", 2, "_", 1)),
    )
    build = lambda p, parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.regexp_extract(text, p, x) for x in parts])
    return F.coalesce(*[F.when(text.rlike(p), build(p, parts)) for p, parts in cases])


def table_no_variants(number: Column) -> Column:
    """FN-20: spellings of a table number: comma as dot, ``I.`` and ``1.`` exchanged."""
    dotted = F.upper(F.translate(F.trim(number), ",", "."))
    roman = F.regexp_replace(dotted, r"^1\.", "I.")
    arabic = F.regexp_replace(dotted, r"^I\.", "1.")
    return F.array_distinct(F.array(dotted, roman, arabic))
