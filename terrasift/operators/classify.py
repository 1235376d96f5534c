"""Area types, sections and headings of tables.

The cascade is one table of rules on the folded heading; the order of its rows is the
contract.  It serves as a Column (``area_type``) and inside the document scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.lines import COORDINATE_WORD, NUMBERED, folded
from terrasift.functions.text import fold

# Area types with their display names.
AREA_TYPES = {
    "RUHSAT_ALANI": "Ruhsat Alanı",
    "CED_ALANI": "ÇED Alanı",
    "MEVCUT_CED_ALANI": "Mevcut ÇED Alanı",
    "YENI_CED_ALANI": "Yeni ÇED Alanı",
    "PROJE_ALANI": "Proje Alanı",
    "ISLETME_IZIN_ALANI": "İşletme İzin Alanı",
    "TESIS_ALANI": "Tesis Alanı",
    "DEPOLAMA_ALANI": "Depolama Alanı",
    "GALERI_ALANI": "Galeri Alanı",
    "CALISILMAYACAK_ALAN": "Çalışılmayacak Alan",
    "SANTIYE_ALANI": "Şantiye Alanı",
    "BITKISEL_TOPRAK_ALANI": "Bitkisel Toprak Alanı",
    "PASA_ALANI": "Pasa Alanı",
    "STOK_ALANI": "Stok Alanı",
    "OCAK_ALANI": "Ocak Alanı",
    "KIRMA_ELEME_ALANI": "Kırma Eleme Alanı",
    "CEVHER_HAZIRLAMA_ALANI": "Cevher Hazırlama Alanı",
    "ATIK_ALANI": "Atık Alanı",
    "HAVUZ_ALANI": "Havuz Alanı",
    "DIGER": "Diğer Alanlar",
}
LICENCE = ("RUHSAT_ALANI",)
CED = ("CED_ALANI", "MEVCUT_CED_ALANI", "YENI_CED_ALANI")
DOMINANT = (*LICENCE, *CED, "PROJE_ALANI", "ISLETME_IZIN_ALANI")
AUXILIARY = ("STOK_ALANI", "TESIS_ALANI", "KIRMA_ELEME_ALANI", "PASA_ALANI", "HAVUZ_ALANI", "SANTIYE_ALANI", "BITKISEL_TOPRAK_ALANI", "ATIK_ALANI", "CEVHER_HAZIRLAMA_ALANI", "DEPOLAMA_ALANI", "GALERI_ALANI", "OCAK_ALANI")

_PLACE = "ALAN|SAHA|SINIR|KOORDINAT|POLIGON|IZIN"
_NOUNS = (
    ("BITKISEL_TOPRAK_ALANI", ("BITKISEL TOPRAK",)),
    ("PASA_ALANI", ("PASA", "ALAN")),
    ("STOK_ALANI", ("STOK", "ALAN|SAHA")),
    ("SANTIYE_ALANI", ("SANTIYE (?:ALANI|SAHASI|YERLESIM|TESIS)",)),
    ("KIRMA_ELEME_ALANI", ("KIRMA[ \\-]*ELEME",)),
    ("CEVHER_HAZIRLAMA_ALANI", ("CEVHER HAZIRLAMA",)),
    ("ATIK_ALANI", ("ATIK (?:DEPO|DEPOLAMA )?\\w* ?ALANI|ATIK ALANI",)),
    ("HAVUZ_ALANI", ("(?:SEDIMANTASYON|COKELTME|COKELTIM) HAVUZU",)),
    ("TESIS_ALANI", ("UNITESI|\\bUNITE\\b|TESISI", "KOORDINAT")),
)
#: (type, whether text in parentheses is left out, patterns that must all occur), first match wins.
RULES = (
    *((kind, True, patterns) for kind, patterns in _NOUNS),
    ("CALISILMAYACAK_ALAN", False, ("CALISMA YAPILMAYACAK|CALISILMAYACAK|CALISMA YAPILMAMASI|FAALIYET (?:YAPILMAYACAK|YURUTULMEYECEK)",)),
    ("GALERI_ALANI", False, ("GALERI",)),
    ("RUHSAT_ALANI", False, ("RUHSAT ALANI|RUHSAT SAHASI|RUHSAT SINIRI|RUHSAT POLIGON|RUHSATLI ALAN|SICIL.*NOLU.*ALAN",)),
    ("YENI_CED_ALANI", False, ("CED", "TALEP EDILEN|PROJEYE KONU|PLANLANAN|ONGORULEN|YENI|GENISLEME|ILAVE|EK ALAN|KAPASITE ARTISI")),
    ("YENI_CED_ALANI", False, ("YENI OCAK|PLANLANAN YENI", "KOORDINAT")),
    ("MEVCUT_CED_ALANI", False, ("CED", "MEVCUT")),
    ("ISLETME_IZIN_ALANI", False, ("ISLETME IZ(?:IN|NI) (?:ALANI|SAHASI)|URETIM IZIN",)),
    ("CED_ALANI", False, ("CED", _PLACE)),
    *((kind, False, patterns) for kind, patterns in _NOUNS),
    ("OCAK_ALANI", False, ("OCAK|URETIM", "ALAN|SAHA")),
    ("TESIS_ALANI", False, ("TESIS", "ALAN")),
    ("PROJE_ALANI", False, ("PROJE", "ALAN|SAHA|KOORDINAT|KONU")),
)


def area_type(heading: Column) -> Column:
    """CLS-01, CLS-03: the area type of a heading; DIGER when no rule holds or it is null."""
    whole = fold(F.coalesce(heading, F.lit("")))
    plain = fold(F.regexp_replace(F.coalesce(heading, F.lit("")), r"\([^)]*\)", " "))
    out = None
    for kind, outside, patterns in RULES:
        test = F.lit(True)
        for p in patterns:
            test = test & (plain if outside else whole).rlike(p)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("DIGER")


_COMPILED = [(kind, outside, [re.compile(p) for p in patterns]) for kind, outside, patterns in RULES]


def area_type_of(heading: str) -> str:
    """The same cascade inside the document scan."""
    whole, plain = folded(heading or ""), folded(re.sub(r"\([^)]*\)", " ", heading or ""))
    return next((kind for kind, outside, patterns in _COMPILED if all(p.search(plain if outside else whole) for p in patterns)), "DIGER")


def heading_of(text: str) -> str:
    """CLS-02: numbered caption (and up to three lines more), else the coordinate-word line with up
    to three before it, else the first three meaningful lines of twenty."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("---")]
    ups = [folded(x) for x in lines]
    data = [len(re.findall(r"[0-9]{6,7}", x)) >= 2 for x in ups]

    def until_data(i: int, n: int) -> list[str]:
        out = []
        for k in range(i, min(len(lines), i + n)):
            if data[k]:
                break
            out.append(lines[k])
            if re.search(COORDINATE_WORD, ups[k]):
                break
        return out

    for i, up in enumerate(ups):
        if re.search(NUMBERED, up):
            return " ".join(until_data(i, 4))
    for i, up in enumerate(ups):
        if re.search(COORDINATE_WORD, up):
            return " ".join(x for k, x in enumerate(lines[max(0, i - 3) : i + 1], max(0, i - 3)) if not data[k])
    return " ".join(x for k, x in enumerate(lines[:20]) if not data[k] and re.search("[A-Z]{3}", ups[k]))[:400]


_SECTIONS = (("PROJEYE KONU ALAN", 100), ("PROJE ALANI KOORDINATLARI", 90), ("RUHSAT SAHASI", 80), ("RUHSAT ALANI", 80), (COORDINATE_WORD, 60))


def section_score(section: Column) -> Column:
    """CLS-06."""
    up, out = fold(section), None
    for pattern, score in _SECTIONS:
        out = F.when(up.rlike(pattern), score) if out is None else out.when(up.rlike(pattern), score)
    return F.coalesce(out, F.lit(10))


def section_of(lines: Column) -> Column:
    """CLS-06: the first of twenty lines that names a section, else ``Bilinmeyen Alan``."""
    named = F.filter(F.slice(lines, 1, 20), lambda x: section_score(x) > 10)
    return F.coalesce(F.trim(F.try_element_at(named, F.lit(1))), F.lit("Bilinmeyen Alan"))


def inherited(tables: DataFrame, doc: str = "doc_id", order: str = "table_index", kind: str = "table_type") -> DataFrame:
    """CLS-05: an untyped table takes the last type before it that is no auxiliary one."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last_value(F.when(~F.col(kind).isin("DIGER", *AUXILIARY), F.col(kind)), ignoreNulls=F.lit(True)).over(before)
    return tables.withColumn("effective_type", F.when(F.coalesce(F.col(kind), F.lit("DIGER")) == "DIGER", F.coalesce(carried, F.lit("DIGER"))).otherwise(F.col(kind)))


def prioritised(tables: DataFrame) -> DataFrame:
    """CLS-04, CLS-06, TOP-01: each table's section, its score, whether it is geographic, and its place
    in its document by score, tables of equal score in their order."""
    sectioned = tables.withColumn("section", section_of(F.split("text", "\n")))
    scored = sectioned.withColumn("section_score", section_score(F.col("section"))).withColumn("geographic", geographic_primary(F.col("text")))
    place = Window.partitionBy("doc_id").orderBy(F.col("section_score").desc(), "table_index")
    return scored.withColumn("priority", F.row_number().over(place))


def geographic_primary(text: Column) -> Column:
    """CLS-04: few UTM numbers, and a geographic header or six numbers of degree range."""
    up = fold(text)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), 1), lambda x: F.translate(x, ",", ".").try_cast("double"))
    utm = F.size(F.filter(numbers, lambda v: v.between(100000, 5000000)))
    degrees = F.size(F.filter(numbers, lambda v: v.between(25, 46) & (v != F.floor(v))))
    return F.coalesce((utm < 4) & (up.rlike("ENLEM|BOYLAM|COGRAFI") | (degrees >= 6)), F.lit(False))
