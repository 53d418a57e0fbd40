"""Garbled text."""

import random

import numpy as np
import pytest

from quillon.llm import encoding as en

SOURCES = {
    "en": "the garden of the reader explains the quiet promise and a lamp is named near every road because the word often returns",
    "fr": "le château était près du théâtre où l'élève répète sa leçon d'été avec un accent aigu et grave à côté de la forêt",
    "tr": "küçük çocuk bahçede oynuyor ve güzel çiçekler topluyor sonra eve dönüyor şimdi ağaç altında yatıyor ışık çok güçlü değil",
    "ru": "маленький мальчик читает книгу в саду и слушает как поют птицы потом он идёт домой через широкое поле к реке",
    "ar": "هذا الكتاب عن الحديقة القديمة التي كان فيها رجل يقرأ على ضوء المصباح كل ليلة قبل أن ينام مع أولاده",
}


def _corpus(n=60):
    rnd = random.Random(11)
    docs = []
    for lang, text in SOURCES.items():
        w = text.split()
        for _ in range(n):
            docs.append((lang, " ".join(rnd.choices(w, k=60)) + "."))
    return docs


GARBLE = {
    "utf8-1252": lambda t: t.encode("utf-8").decode("latin-1"),
    "utf8-437": lambda t: t.encode("utf-8").decode("cp437"),
    "twice": lambda t: t.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
}
SWAPS = {"ru": ("cp1251", "latin-1"), "ar": ("cp1256", "latin-1")}


@pytest.fixture(scope="module")
def found(spark):
    docs = [t for _, t in _corpus()]
    bad = {}
    rnd = random.Random(2)
    clean = _corpus(8)
    for k, (lang, t) in enumerate(clean):
        if lang == "en":
            continue
        name = list(GARBLE)[k % 3]
        bad[len(docs)] = t
        docs.append(GARBLE[name](t))
        if lang in SWAPS and rnd.random() < 0.8:
            right, wrong = SWAPS[lang]
            bad[len(docs)] = t
            docs.append(t.encode(right, "ignore").decode(wrong))
    good = ["Copied for Þórvýn and Ðalsý. " + docs[0], "«ê ô û â» " + docs[0], docs[0] + " Ø = no gloss; ± two lines", None, "", "x", "√2 ≈ 1.41, Γ and Ω"]
    lost = ["He�s " + docs[0]]
    every = docs + lost + good
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(every)], "doc_id long, text string, mapping string")
    got = {r["key"]: r for r in en.find_garbled(df, "doc_id", "text").collect()}
    return docs, bad, lost, every, got


def test_only_garbled_rows_are_found(found):
    docs, bad, lost, every, got = found
    assert set(bad) | {len(docs)} == set(got)
    assert got[len(docs)]["lossy"]


def test_texts_are_restored(found):
    docs, bad, _, _, got = found
    right = sum(got[i]["restored"] == t for i, t in bad.items() if i in got)
    assert right >= 0.9 * len(bad)


def test_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = rng.integers(-4, 5, 12).astype(float)
        got = en.maximal_segments(w, 0.5)
        best = max((w[i:j].sum() for i in range(12) for j in range(i + 1, 13)), default=0)
        if best > 0.5:
            assert max(w[s:e].sum() for s, e in got) == best
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    assert en.find_garbled(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
