import numpy as np
from pyspark.sql import functions as F

from terrasift.llm import language

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it was there with them for the whole evening",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann war er mit ihnen die ganze nacht",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis il était avec eux pour toute la soirée",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego estaba allí con ellos durante toda la noche",
}


def test_held_out(spark):
    rows = [(i * 4 + j, " ".join(t.split()[i % 9 :] + t.split()[: i % 7]), lang) for i in range(20) for j, (lang, t) in enumerate(TEXTS.items())]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "the dog", None), (None, "le chien", "fr")]
    df = spark.createDataFrame([(i, t, lang, "c") for i, t, lang in rows], "doc_id long, text string, lang string, score string")
    model = language.learn(df.where("doc_id < 60"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows if i is not None and i < 900)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_nothing_learnt_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.learn(df)
    assert [tuple(r) for r in language.predict(df, model).collect()] == [(1, "und", 0.0)]
    assert language.predict(df.where(F.lit(False)), model).collect() == []


def test_filter_has_no_false_negatives_and_is_corrected():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << language.CODE_BITS, 5000).astype(np.uint64)
    slots = np.zeros((1, 1 << language.SLOT_BITS), np.uint64)
    for at in language.slots_of(codes):
        slots[0][at] |= np.uint64(1)
    mask = np.bitwise_and.reduce([slots[0][a] for a in language.slots_of(codes)])
    assert (mask & np.uint64(1)).all()
    assert language.corrected(np.array([[100.0]]), np.array([100]), slots, 1)[0, 0] <= 100


def test_more_than_63_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 12, f"l{i:03d}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.learn(df)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 70
