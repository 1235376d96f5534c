"""Personal data by offset-preserving deobfuscation.

Base spans come from the plain text: the patterns of email, ip, card and phone, leftmost
and non-overlapping per kind, matches that fail their check dropped without retry.

Added spans: transducers rewrite homoglyphs and full-width forms, digits spelled as words
and the at/dot disguises, and keep for each produced character the source span it stems
from.  The same patterns run over the rewritten text, and what they find is mapped back;
a span that touches no base span of its kind is added.  A text in which no transducer
finds work gets none, so the transducers run only where one trigger pattern matches.

What counts as a disguise is bounded, so that no text takes more than linear time: a local
part has seven pieces of 64 characters at most and begins within ``REACH`` characters of its
at, a domain has nine labels at most, and three blanks at most stand on either side of a
disguised at or dot.  Base spans have no such bounds.

Spans are [start, end) in code points of the source.  A null text counts as empty and
has no spans; other columns pass through; repeated rows come out as often as they occur.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SEPARATORS = re.compile(r"[^0-9]+")

# Number words of the four languages, and letters that look like ASCII ones.
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝАВЕКМНОРСТХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwABEKMHOPCTXIJSaoivptukABEZHIKMNOPTYX", strict=True))

TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app ai de fr es uk eu ch at us ca au jp cn ru br it nl se no pl test example".split())

_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Three number words or digits in a row, with a word among them, at word boundaries.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_NUMBER}|[0-9]+|plus)[ \-.,]{{1,2}}){{2,}}(?:{_NUMBER}|[0-9]+)(?!\w)", re.I)
_GAP = re.compile(r"(?<=[0-9+])[\x20.,-]+(?=[0-9])")
_ONE_NUMBER = re.compile(rf"(?<!\w)(?:{_NUMBER}|plus)(?!\w)", re.I)
# Blanks are counted and labels possessive, so that no text makes a pattern walk it twice.
_AT = r"\s{0,3}[\[({<]\s{0,3}(?:at|arroba|chez|@)\s{0,3}[\])}>]\s{0,3}|\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3}"
_DOT = r"\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3}|\."
_AN_AT = re.compile(_AT, re.I)
#: The local part up to its at, read in the REACH characters before it; and the labels after it.
_BEFORE = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:{_DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,6}}$", re.I)
_AFTER = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_DOT})[A-Za-z0-9-]++){{1,8}}", re.I)
REACH = 160
_AT_OR_DOT = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_DISGUISED_IP = re.compile(r"(?<!\w)[0-9]{1,3}(?:\s{0,3}[\[({]\s{0,3}(?:dot|\.)\s{0,3}[\])}]\s{0,3}[0-9]{1,3}|\s{1,3}dot\s{1,3}[0-9]{1,3}|\.[0-9]{1,3}){3}(?!\w)", re.I)
_IP_ONLY = re.compile(r"[0-9\s.()\[\]{}dotDOT]+")
#: Meets every alternative of _AT and _DOT but the plain signs: a bare at counts before labels, of which
#: a dot in disguise would be met itself, and an @ with a blank on either side.
_DISGUISE_TRIGGER = re.compile(r"[\[({<]\s{0,3}(?:at|dot|arroba|chez|punkt|point|punto|@|\.)\s{0,3}[\])}>]|\sdot\s|\sat\s{1,3}[A-Za-z0-9-]++\.[A-Za-z0-9-]|\s@|@\s", re.I)
_FOREIGN = re.compile(r"[²³¹Ͱ-֏٠-٩۰-۹०-९​-‍‐-―․⁠-₉①-⓿﹐-﻿＀-･\U0001d400-\U0001d7ff]")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _ip_ok(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in value.split("."))


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGITS.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _SEPARATORS.sub("", m[0])) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_SEPARATORS.sub("", m[0])) <= 15]
    return found


class Mapped:
    """A text under rewriting, with the source span of each character."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by other text, for ordered, non-overlapping edits."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _glyph(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in "​‌‍⁠﻿":
        return ""
    if "‐" <= c <= "―":
        return "-"
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


def deobfuscated(text: str) -> Mapped | None:
    """The text after all transducers; None when none of them changes it."""
    foreign = not text.isascii() and _FOREIGN.search(text)
    spelled = _SPELLED.search(text)
    if not (foreign or spelled or _DISGUISE_TRIGGER.search(text)):
        return None
    out = Mapped(text)
    if foreign:
        out.rewrite([(m.start(), m.end(), new) for m in _FOREIGN.finditer(out.text) if (new := _glyph(m[0])) != m[0]])
    edits = []
    for run in _SPELLED.finditer(out.text):
        for m in _ONE_NUMBER.finditer(out.text, run.start(), run.end()):
            word = m[0].lower()
            edits.append((m.start(), m.end(), "+" if word == "plus" else str(DIGIT_WORDS[word])))
    if edits:
        out.rewrite(edits)
        # digits that were words lose the blanks between them: one number, not many
        out.rewrite([(m.start(), m.end(), "") for m in _GAP.finditer(out.text) if _from_words(out, m)])
    edits = []
    for a, b in sorted([*_disguised_emails(out.text), *(m.span() for m in _DISGUISED_IP.finditer(out.text))]):
        if edits and a < edits[-1][1]:
            continue
        whole = out.text[a:b]
        kinds = list(_AT_OR_DOT.finditer(whole))
        spaced = [k for k in kinds if k[0] not in "@."]
        # prose has " at " and " dot " too: the bare words count only before a top-level domain
        bare = any(k[0].strip().lower() in ("at", "dot") for k in spaced)
        if spaced and (not bare or _IP_ONLY.fullmatch(whole) or re.split(_DOT, whole, flags=re.I)[-1].lower() in TOP_LEVEL):
            edits += [(a + k.start(), a + k.end(), "@" if k["at"] else ".") for k in spaced]
    out.rewrite(edits)
    return out if out.text != text else None


def _disguised_emails(text: str):
    """Spans of a local part, an at and labels joined by dots, however these are written."""
    for at in _AN_AT.finditer(text):
        low = max(0, at.start() - REACH)
        before = _BEFORE.search(text[low : at.start()])
        after = _AFTER.match(text, at.end()) if before else None
        if after:
            yield low + before.start(), after.end()


def _from_words(out: Mapped, m: re.Match) -> bool:
    """Whether a neighbour of the separator was spelled: its source is longer than itself."""
    return any(out.ends[i] - out.starts[i] > 1 for i in (m.start() - 1, m.end()))


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, added spans) by kind."""
    base = spans_of(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out = deobfuscated(text)
    if out is not None:
        for kind, spans in spans_of(out.text).items():
            starts, ends = [a for a, _ in base[kind]], [b for _, b in base[kind]]
            for a, b in spans:
                source = out.starts[a], out.ends[b - 1]
                if bisect_right(ends, source[0]) == bisect_left(starts, source[1]):  # touches no base span
                    added[kind].append(source)
    return base, added


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, all spans, and how many were added."""
    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], F.lit("").alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_added")).schema

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, added = all_spans(value.as_py() or "")
                both = {k: base[k] + added[k] for k in KINDS} if any(added.values()) else base
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), sum(map(len, added.values()))))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names[1:]]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked_text(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping ones the first, longest."""
    base, added = all_spans(text)
    order = sorted(((a, -b, i) for i, k in enumerate(KINDS) for a, b in base[k] + added[k]))
    out, at = [], 0
    for a, minus_b, i in order:
        if a >= at:
            out += [text[at:a], f"<{KINDS[i].upper()}>"]
            at = -minus_b
        elif -minus_b > at:
            at = -minus_b  # what overlaps the last one goes with it
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data masked in the text; a length column follows the new text."""
    rest = [c for c in docs.columns if c != text]
    ordered = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))

    def run(batches):
        for batch in batches:
            column = batch.column(len(rest))
            new = pa.array([None if not v.is_valid else masked_text(v.as_py()) for v in column], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), new], names=[*rest, text])

    prepare(docs.sparkSession)
    out = ordered.mapInArrow(run, ordered.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
