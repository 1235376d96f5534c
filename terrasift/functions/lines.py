"""Predicates on lines, as patterns shared by Columns and by the document scan.

Patterns run on folded text (upper case, letters without accents) in both worlds.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.text import ACCENTED, PLAIN, fold

# Vocabularies of the reports, folded.
PAGE_MARK = r"^--- SAYFA ([0-9]+) \[(.*)\] ---$"
COORDINATE_WORD = r"KOORDINAT|COORDINATE"
AREA_WORD = r"ALAN|SAHA|SINIR|POLIGON|RUHSAT|CED|OCAK|STOK|PASA|TESIS|UNITE|GALERI|HAVUZ|PROJE"
NUMBERED = r"^(?:TABLO|CIZELGE|TABLE)\s*[0-9IVX]+(?:[.\-][0-9]+)*"
COLUMN_HEADER = r"^(?:NO|Y|X|NOKTA.*|SAGA|SAGA \(Y\)|YUKARI|YUKARI \(X\)|ENLEM|BOYLAM|SIRA NO|KOSE NO|KOSE NOKTASI)$"
TOTAL = r"TOPLAM ALAN|^ALAN\s*:\s*[0-9.,]+\s*(?:HA|M2|HEKTAR)"
SECTION = r"^[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}\.?\s+[A-Z]"
CRS_LINE = r"^(?:DATUM|KOOR\.? SIRASI|TURU|TURU? ?\(?TIPI\)?|ZON|ZONE|DILIM|D\.?O\.?M\.?|OLCEK|PAFTA|PROJEKSIYON|ED[ \-]?50|WGS[ \-]?84|UTM|COGRAFIK)\b"
NON_AREA = r"SONDAJ|BLOK MODEL|REZERV|NUMUNE"
STRUCTURE = (r"\bDATUM\b", r"\bZON\b|\bZONE\b|\bDILIM\b", r"\bUTM\b", r"ED[ \-]?50|WGS[ \-]?84", r"\bSAGA\b|\bYUKARI\b", r"\bNOKTA\b|\bKOSE\b", r"\bENLEM\b|\bBOYLAM\b", r"KOORDINAT")
INDEX_HEADING = r"^(?:TABLOLAR (?:DIZINI|LISTESI)|TABLO LISTESI|CIZELGELER)$"
TOC_HEADING = r"^(?:ICINDEKILER|ICINDEKILER DIZINI)$"
APPENDIX = r"\bEK[ \-]*1\b.*KOORDINAT|KOORDINAT.*\bEK[ \-]*1\b|SECILEN YERIN KOORDINAT"
UNRELATED = r"^EK[ \-]*(?:[2-9]|1[0-9])\b|^KAYNAKCA|^SEKILLER (?:DIZINI|LISTESI)|^BIBLIYOGRAFYA"
LEADERS = r"\.{4,}|(?:\. ){4,}"
NUMBER = re.compile(r"[+-]?(?:[0-9]{1,3}(?:[. ][0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:[.,][0-9]+)?)")

_FOLD = str.maketrans(dict(zip(ACCENTED, PLAIN, strict=True)))


def folded(text: str) -> str:
    """The Python twin of ``text.fold``."""
    upper = unicodedata.normalize("NFC", text.replace("ß", "ss")).upper().translate(_FOLD)
    return re.sub("[̀-ͯ]", "", upper)


def utm_numbers(line: Column) -> Column:
    """How many numbers of a line have the magnitude of an easting or a northing."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"([0-9]{6,7}(?:[.,][0-9]+)?)"), 1), lambda x: F.translate(x, ",", ".").try_cast("double"))
    return F.size(F.filter(found, lambda v: v.between(100000, 999999) | v.between(3000000, 5000000)))


def flags(line: Column) -> dict[str, Column]:
    """PR-01..07, PR-10..12 for each line, by name."""
    up = F.trim(fold(line))
    bare = F.coalesce(up, F.lit("")).isin("", ":")
    page, metadata = up.rlike(PAGE_MARK), up.rlike(CRS_LINE)
    data = (utm_numbers(line) >= 2) | up.rlike(r"^[0-9][0-9.,]*\s*(?::\s*[0-9][0-9.,]*)?$")
    return {
        "noise": F.coalesce(bare | page | metadata, F.lit(True)),
        "data": F.coalesce(data, F.lit(False)),
        "column_header": F.coalesce(up.rlike(COLUMN_HEADER), F.lit(False)),
        "numbered": F.coalesce(up.rlike(NUMBERED), F.lit(False)),
        "table_start": F.coalesce(up.rlike(COORDINATE_WORD) & up.rlike(AREA_WORD) & ~up.rlike(COLUMN_HEADER) & ~up.rlike(LEADERS), F.lit(False)),
        "table_end": F.coalesce(up.rlike(TOTAL), F.lit(False)),
        "section_start": F.coalesce(up.rlike(SECTION) & ~data, F.lit(False)),
        "index_heading": F.coalesce(up.rlike(INDEX_HEADING), F.lit(False)),
        "toc_heading": F.coalesce(up.rlike(TOC_HEADING), F.lit(False)),
        "unrelated_section": F.coalesce(up.rlike(UNRELATED) & ~up.rlike(LEADERS), F.lit(False)),
        "late_caption": F.coalesce((up.rlike(NUMBERED) | up.rlike(COORDINATE_WORD)) & ~up.rlike(r"^[0-9]+\s*NO"), F.lit(False)),
    }


def is_real_table(text: Column) -> Column:
    """PR-08, PR-09: two eastings, two northings, and structure words or the coordinate word."""
    up = fold(text)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{6,7}(?:[.,][0-9]+)?)"), 1), lambda x: F.translate(x, ",", ".").try_cast("double"))
    east = F.size(F.filter(numbers, lambda v: v.between(100000, 999999)))
    north = F.size(F.filter(numbers, lambda v: v.between(3000000, 5000000)))
    words = sum((up.rlike(p).cast("int") for p in STRUCTURE), F.lit(0))
    return F.coalesce((east >= 2) & (north >= 2) & ((words >= 2) | up.rlike(COORDINATE_WORD)) & ~up.rlike(NON_AREA), F.lit(False))


def plausible_licence(value: Column, strong: bool) -> Column:
    """PR-14: 4 to 10 digits, no northing; weak contexts also exclude years and eastings."""
    n = value.try_cast("long")
    ok = value.rlike("^[0-9]{4,10}$") & ~n.between(3000000, 4999999)
    return F.coalesce(ok if strong else ok & ~n.between(1990, 2035) & ~n.between(100000, 899999), F.lit(False))


def looks_like_company(value: Column) -> Column:
    """PR-13."""
    return F.coalesce(fold(value).rlike(r"\b(?:A\.?S\.?|LTD|STI|SANAYI|TICARET|MADENCILIK|INSAAT|HOLDING|ANONIM|LIMITED)\b"), F.lit(False))


def looks_like_heading(value: Column) -> Column:
    """PR-13: a line of a cover's title rather than of a company's name; null is one."""
    return F.coalesce(fold(value).rlike(r"\b(?:CED|CEVRESEL|ETKI|DEGERLENDIRME|PROJE|RAPOR|RAPORU|DOSYA|DOSYASI|BAKANLIGI|MUDURLUGU|VALILIGI|KAPASITE|RUHSAT)\b|^[0-9\W]*$"), F.lit(True))
