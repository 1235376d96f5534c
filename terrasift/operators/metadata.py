"""Document metadata from cover text and path, and export names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.lines import looks_like_company, looks_like_heading, plausible_licence
from terrasift.functions.text import clean_value, fold, sanitize

UNKNOWN = "Bilinmiyor"
_LABELS = {
    "company": r"(?imu)^\s*(?:proje sahibi(?:nin adı)?|firma adı|şirket|işletmeci|ruhsat sahibi)\s*[:\-]\s*(\S.*)$",
    "mine_type": r"(?imu)^\s*(?:maden(?:in)? (?:cinsi|türü|grubu)|cevher cinsi)\s*[:\-]\s*(\S.*)$",
    "province": r"(?imu)^\s*(?:il[iı]?|ili)\s*[:\-]\s*([\p{L} ]+?)\s*$",
    "district": r"(?imu)^\s*(?:ilçe(?:si)?)\s*[:\-]\s*([\p{L} ]+?)\s*$",
}
_PAIR = r"(?su)([\p{Lu}][\p{L}]+)\s+(?:İL[İI]|İli|ili)\b.{0,100}?([\p{Lu}][\p{L}]+)\s+(?:İLÇES[İI]|İlçesi|ilçesi)"
#: (pattern, strong context) in the order of preference.
_LICENCES = (
    (r"(?iu)ruhsat\s*(?:no|numarası|nosu)\s*[:.\-]?\s*([0-9]{4,10})", True),
    (r"(?iu)([0-9]{4,10})\s*(?:no'?lu|nolu|numaralı)\s+(?:\S+\s+){0,3}ruhsat", True),
    (r"(?iu)sicil\s*(?:no)?\s*[:.\-]?\s*([0-9]{4,10})", True),
    (r"(?iu)(?:ER|İR|AR)\s*[:.\-]\s*([0-9]{4,10})", False),
)


#: Characters of a cover that are searched for mine types and companies, and of them for quarry nouns.
HEAD, BEGINNING = 20_000, 6_000
# Nouns around mine types, words that are none, and legal forms of companies.
_NAME = r"([\p{L}][\p{L}\-]{2,30}(?:\s+(?:VE|ve|&|/)\s+[\p{L}][\p{L}\-]{2,30})*)"
_QUARRY = rf"(?iu){_NAME}\s+OCA(?:ĞI|ĞINA|ĞININ|KLARI|KLARINA|KLARININ)(?![\p{{L}}])"
_MINES = (rf"(?iu){_NAME}\s+MADEN(?:İ|CİLİĞİ)(?![\p{{L}}])", r"(?iu)(?<![\p{L}])(?:IV|V|I{1,3})\.?\s*GRUP\s+([\p{L}][\p{L}\-]{2,30})")
_PROJECT_NAME = r"(?isu)PROJEN[İI]N\s+ADI(.*?)PROJE\s+(?:BEDEL|[İI]Ç[İI]N)"
NO_MINE = ("MADEN", "ACIK", "YERALTI", "MEVCUT", "YENI", "PROJE", "GRUP")
_LEGAL_FORM = r"(?iu)(?<![\p{L}])(?:LTD\.?\s*[ŞS]T[İI]|A\.?\s*[ŞS]|(?:ANON[İI]M|L[İI]M[İI]TED)\s+Ş[İI]RKET[İI])\.?\s*$"


def _pick(text: Column, pattern: str) -> Column:
    return F.nullif(clean_value(F.regexp_extract(text, pattern, 1)), F.lit(""))


def licence(text: Column) -> Column:
    """MD-05: the first plausible match of the ordered rules (only each rule's first match counts)."""
    picks = [F.when(plausible_licence(F.regexp_extract(text, p, 1), strong), F.regexp_extract(text, p, 1)) for p, strong in _LICENCES]
    return F.coalesce(*picks, F.lit(UNKNOWN))


def document_class(text: Column) -> Column:
    """MD-02: of the first 4000 characters the earlier title, else an explicit class, else unknown."""
    head = fold(F.substring(text, 1, 4000))
    ptd, ced = F.regexp_instr(head, F.lit("PROJE TANITIM DOSYASI")), F.regexp_instr(head, F.lit("(?:CED|CEVRESEL ETKI DEGERLENDIRME\\w*) RAPORU"))
    return F.when((ptd > 0) & ((ced == 0) | (ptd < ced)), "EK-2").when(ced > 0, "EK-1").when(head.rlike(r"EK[ \-]*2\b"), "EK-2").when(head.rlike(r"EK[ \-]*1\b"), "EK-1").otherwise(UNKNOWN)


def path_context(path: Column) -> Column:
    """MD-07: struct(province, ek_tip) of ``.../<province>/<EK-n>/file``."""
    pattern = r"(?iu)([^/\\]+)[/\\](EK-?[12])[/\\][^/\\]+$"
    return F.struct(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias("province"), F.nullif(F.regexp_replace(F.upper(F.regexp_extract(path, pattern, 2)), "EK-?", "EK-"), F.lit("")).alias("ek_tip"))


def distinct_folded(values: Column) -> Column:
    """The values without later ones that differ from an earlier one in case and accents only."""
    keys = F.transform(values, lambda v: fold(v))
    return F.filter(values, lambda v, i: F.array_position(keys, fold(v)) == i + 1)


def mine_types(text: Column) -> Column:
    """MD-04: the labelled types; else the words before a quarry noun in the project's name, or in the text's
    beginning; else those before a mine noun or after a group number.  Split at conjunctions, distinct, upper
    case, joined by `` / ``."""
    head = F.substring(text, 1, HEAD)
    labelled = F.filter(F.array(F.regexp_extract(head, _LABELS["mine_type"], 1)), lambda v: v != "")
    name = F.regexp_extract(head, _PROJECT_NAME, 1)
    quarries = lambda part: F.regexp_extract_all(part, F.lit(_QUARRY), 1)
    nouns = F.flatten(F.array(*[F.regexp_extract_all(head, F.lit(p), 1) for p in _MINES]))
    chosen = F.when(F.size(labelled) > 0, labelled).when(F.size(quarries(name)) > 0, quarries(name)).when(F.size(quarries(F.substring(text, 1, BEGINNING))) > 0, quarries(F.substring(text, 1, BEGINNING))).otherwise(nouns)
    parts = F.flatten(F.transform(chosen, lambda v: F.split(F.upper(v), r"\s+VE\s+|\s*[&/,]\s*")))
    kept = F.filter(F.transform(parts, F.trim), lambda p: (p != "") & ~fold(p).isin(*NO_MINE))
    return F.nullif(F.array_join(distinct_folded(kept), " / "), F.lit(""))


def company(text: Column) -> Column:
    """MD-03: the labelled company, else the first line that ends in a legal form, with up to two lines
    before it that are no report headings."""
    rows = F.filter(F.transform(F.split(F.substring(text, 1, HEAD), r"\r?\n"), F.trim), lambda x: x != "")

    def whole(line: Column, i: Column) -> Column:
        before = lambda k: F.when(i >= k, F.try_element_at(rows, (i + 1 - k).cast("int")))
        one = F.when(~looks_like_heading(before(1)), before(1))
        two = F.when(one.isNotNull() & ~looks_like_heading(before(2)), before(2))
        return F.when(line.rlike(_LEGAL_FORM), clean_value(F.concat_ws(" ", two, one, line)))

    found = F.filter(F.transform(rows, whole), lambda c: c.isNotNull() & looks_like_company(c))
    return F.coalesce(_pick(text, _LABELS["company"]), F.nullif(F.try_element_at(found, F.lit(1)), F.lit("")))


def extract(documents: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """MD-01..07: what the text says, else what the path says, else ``Bilinmiyor``."""
    t, context = F.col(text), path_context(F.col(path))
    pair = lambda i: F.nullif(F.regexp_extract(t, _PAIR, i), F.lit(""))
    unknown = F.lit(UNKNOWN)
    kind = document_class(t)
    out = documents.select(
        "doc_id",
        F.coalesce(company(t), unknown).alias("company"),
        F.coalesce(mine_types(t), unknown).alias("mine_type"),
        F.coalesce(licence(t), unknown).alias("license_no"),
        F.coalesce(pair(1), _pick(t, _LABELS["province"]), context["province"], unknown).alias("province"),
        F.coalesce(pair(2), _pick(t, _LABELS["district"]), unknown).alias("district"),
        F.coalesce(F.when(kind != UNKNOWN, kind), context["ek_tip"], unknown).alias("ek_tip"),
    )
    return out.withColumn("license_no_missing", F.col("license_no") == UNKNOWN)


def export_path(province: Column, ek_tip: Column, licence_no: Column, company: Column, mine: Column) -> Column:
    """MD-08: ``province/Ek-n/licence - company - mine.kml`` with unsafe characters replaced."""
    kind = F.when(F.upper(ek_tip).rlike("^EK-[12]$"), F.concat(F.lit("Ek-"), F.substring(ek_tip, -1, 1))).otherwise(UNKNOWN)
    return F.concat(F.concat_ws("/", sanitize(province), kind, F.concat_ws(" - ", sanitize(licence_no), sanitize(company), sanitize(mine))), F.lit(".kml"))
