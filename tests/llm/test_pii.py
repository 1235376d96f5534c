"""Base spans against the plain patterns; disguises; masking."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from terrasift.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out[kind].append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.+-_ ()%é4\n0 25", max_size=60))
def test_base_spans(text):
    assert pii.spans_of(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "+1 (706) 555-3138", "a.b@c.de", "10.0.0.255", " at ", " dot ", "five ", "plus one ", "＠", "а", "4", "x", " ", ",", "٣", "²"]), max_size=14).map("".join))
def test_added_spans_are_apart_from_base_and_inside(text):
    base, added = pii.all_spans(text)
    assert base == plain(text)
    for kind in pii.KINDS:
        for a, b in added[kind]:
            assert 0 <= a < b <= len(text) and all(b <= x or y <= a for x, y in base[kind])
    assert pii.masked_text(text) is not None


def added(text):
    base, more = pii.all_spans(text)
    assert not any(base.values())
    return {k: [text[a:b] for a, b in v] for k, v in more.items() if v}


def test_disguises():
    assert added("write to jo.81 at mail7 dot example dot com now") == {"email": ["jo.81 at mail7 dot example dot com"]}
    assert added("x [at] y [dot] org") == {"email": ["x [at] y [dot] org"]}
    assert added("jöe ｊoe＠example．com") == {"email": ["ｊoe＠example．com"]}
    assert added("ip 10 dot 0 dot 0 dot 255 x") == {"ip": ["10 dot 0 dot 0 dot 255"]}
    assert added("call plus one seven zero six five five five three one three eight ok") == {"phone": ["plus one seven zero six five five five three one three eight"]}
    assert added("card ４１１１ １１１１ １１１１ １１１１.") == {"card": ["４１１１ １１１１ １１１１ １１１１"]}


def test_clean_prose_has_none():
    for text in ("look at the dot of it", "one two three go", "meet at noon, dot by dot", "Größe und Maß für élan", "un deux trois soleil"):
        base, more = pii.all_spans(text)
        assert not any(base.values()) and not any(more.values()), text


def test_queries_and_mask(spark):
    rows = [(1, "mail a.b@c.de or x at y dot com", "en", 31), (2, None, "en", 0), (3, "", "en", 0), (None, "+1 (706) 555-3138", None, 17)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[1]["n_email"] == 1 and got[1]["spans"] == "email:5:13,email:17:31" and got[1]["n_added"] == 1
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == got[3]["base_sha256"]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask(df).collect()}
    assert out[1] == ("mail <EMAIL> or <EMAIL>", 23) and out[2] == (None, 0) and out[None] == ("<PHONE>", 7)
    assert pii.mask(df).columns == df.columns and pii.find(df.limit(0)).collect() == []


def test_long_texts_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "+1" * 50_000, "a@" * 50_000, "1.2.3." * 30_000, "five " * 30_000, " at " * 30_000):
        pii.all_spans(text)


PROSE = ["jane.roe at example.com", "jane @example.com", "jane@ example.com", "jane\n@\nexample.com", "a.b at  c.de", "x [at] y.org", "x AT y dot org", "look at this. Then go.", "a.b@c.de", "10.0.0.255", "five at four.x", " ", "word", "@", "."]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PROSE), max_size=6).map(" ".join))
def test_unrelated_text_changes_no_span(text):
    """The trigger opens for all that the transducers find, so text that opens it adds nothing."""
    opener = "(dot) ; "
    moved = [{k: [(a - len(opener), b - len(opener)) for a, b in v] for k, v in found.items()} for found in pii.all_spans(opener + text)]
    assert moved == list(pii.all_spans(text))


def test_bare_disguises_open_the_trigger():
    for text, span in [("write to jane.roe at example.com now", (9, 32)), ("jane @example.com", (0, 17)), ("jane@ example.com", (0, 17)), ("jane\n@\nexample.com", (0, 18))]:
        assert pii.all_spans(text)[1]["email"] == [span]


def test_other_columns_pass_through_whatever_their_names(spark):
    df = spark.createDataFrame([("a.b@c.de", 1, "s", "x", True, 7)], "text string, doc_id long, spans string, n_email string, base_sha256 boolean, kind int")
    assert pii.find(df).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    (r,) = pii.mask(df).collect()
    assert tuple(r) == ("<EMAIL>", 1, "s", "x", True, 7)
