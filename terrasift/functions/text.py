"""Folding, cleaning and hashing of text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals and the plain letters they fold to.
ACCENTED = "ÇĞİIÖŞÜÂÎÛÀÁÄÃÈÉÊËÌÍÏÑÒÓÔÕÙÚŸ"
PLAIN = "CGIIOSUAIUAAAAEEEEIIINOOOOUUY"


def fold(text: Column, punctuation: bool = False, zero_in_words: bool = False) -> Column:
    """FN-15: upper case with letters folded; options blank punctuation and read 0 in words as O."""
    out = F.translate(F.upper(F.replace(text, F.lit("ß"), F.lit("ss"))), ACCENTED, PLAIN)
    out = F.regexp_replace(out, r"\p{M}+", "")
    if zero_in_words:
        out = F.regexp_replace(out, r"(?<=[A-Z])0(?=[A-Z])", "O")
    if punctuation:
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), " +", " "))
    return out


def sanitize(value: Column, default: str = "Bilinmiyor", limit: int = 150) -> Column:
    """FN-21: a path component: unsafe and control characters become ``_``, blanks single."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ._"))
    out = F.btrim(F.substring(out, 1, limit), F.lit(" ._"))
    return F.when(out == "", default).otherwise(out)


def clean_value(value: Column) -> Column:
    """FN-22: single blanks, cut at an address or phone word, label prefix gone."""
    out = F.regexp_replace(F.trim(value), r"\s+", " ")
    out = F.element_at(F.split(out, r"(?iu)\s(?:adres|address|tel|telefon|faks|fax|e-?posta)\b"), 1)
    return F.btrim(F.regexp_replace(out, r"^[:\-–\s]+", ""), F.lit(" :;,-"))


def usable(text: Column) -> Column:
    """SRC-05: 50 visible characters, few controls, mostly letters and digits, little mojibake."""
    shown = F.length(F.regexp_replace(text, r"[\s\p{Z}]", ""))
    n = F.greatest(F.length(text), F.lit(1))
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    broken = F.regexp_count(text, F.lit("Ã.|Ä.|Å.|ï¿½|�"))
    good = (shown >= 50) & (controls / n <= 0.01) & (letters / F.greatest(shown, F.lit(1)) >= 0.45) & (broken < 2)
    return F.coalesce(good, F.lit(False))


def page_marker(page: Column, method: Column) -> Column:
    """SRC-06: the line that opens a page in marked text."""
    return F.format_string("--- Sayfa %d [%s] ---", page.cast("int"), method)


def identity(*parts: Column) -> Column:
    """FN-23: SHA-256 of parts joined by newlines (null parts are empty)."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
