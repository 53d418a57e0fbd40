"""Look-alike character forms."""

import random
import unicodedata as ud

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import charforms as cf

ALIKE = [
    ("se​st", "sest"), ("ﬁne", "fine"), ("ｅｘｐ １", "exp 1"), ("café", "café"), ("а рaw", "a paw"), ("a b c", "a b c"), ("كيف", "کیف"), ("على", "علی"), ("ِّ".join("بب"), "ِّ".join("بب")),
    ("ﻛﺘﺎﺏ", "كتاب"), ("ё", "ё"), ("Ӏ", "I"), ("so­ft", "soft"), ("مُؤن", "مُؤن"),
]
APART = [("x²", "x2"), ("①", "1"), ("is", "IS"), ("cafe", "café"), ("كتاب", "كتا"), ("علي", "علی"), ("ملك", "ملک"), ("ı", "i"), ("a b", "ab"), ("ёж", "еж"), ("a.", "a")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_equal_looks(a, b):
    assert cf.canonical(a) == cf.canonical(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_different_looks(a, b):
    assert cf.canonical(a) != cf.canonical(b)


def test_words_keep_their_script():
    assert cf.canonical("cоcна и дом") == "сосна и дом"
    assert cf.canonical("pаper") == "paper" and cf.canonical("сор а нет") == "сор а нет"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeoсаеор ёéعكکیيىﻛ２²ِّ̧́‍ ﻿.") ), max_size=24))
def test_segments_equal_whole_normalization(text):
    out = cf.canonical(text)
    assert cf.canonical(out) == out  # one form per text
    t = cf._tables()
    whole = cf._positional(ud.normalize("NFD", text.translate(t.one)).translate(t.like), "")
    whole = t.spaces.sub(" ", ud.normalize("NFC", whole)).strip(" ")
    assert cf.skeleton(text) == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aeoсаеорхкшж ёйéعكکیيىﻛ２²ِّ̧́\u200d\ufeff.  οακΑΩµᏟꓢ\t\nﬁg")), max_size=16)), max_size=6))
def test_batches_equal_single_texts(texts):
    whole = [None if t is None else cf.canonical(t) for t in texts]
    assert cf.canonical_batch(texts) == whole
    assert cf.canonical_batch(texts, chars=1) == whole


@pytest.mark.parametrize(("a", "b"), [("ᏟᎪT", "CAT"), ("ꓢꓲꓖN", "SIGN"), ("ᴄᴏw", "cow"), ("κ", "к")])
def test_letters_of_rarer_scripts(a, b):
    assert cf.canonical(a) == cf.canonical(b)


def _pairs(data, field):
    out = set()
    for i, (a, x) in enumerate(data):
        for b, y in data[i + 1 :]:
            if x and y and x != y and a != b and cf.canonical(x) and cf.canonical(x) == cf.canonical(y):
                out.add((min(a, b), max(a, b), field))
    return out


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    base = ["kitab one", "كتاب على", "сосна", "fine café"]
    variants = [lambda t: t, lambda t: t.replace("i", "і"), lambda t: t.replace(" ", " "), lambda t: t.replace("ك", "ک"), lambda t: ud.normalize("NFD", t), lambda t: t + "x"]
    data = [(i, rnd.choice(variants)(rnd.choice(base))) for i in range(60)] + [(100, None), (101, ""), (102, "​"), (103, base[0]), (103, base[0])]
    df = spark.createDataFrame([(i, t, t, "extra", 1) for i, t in data], "id int, f string, g string, look string, form int")
    assert set(rows(cf.alike_pairs(df, "id", ["f", "g"]))) == _pairs(data, "f") | _pairs(data, "g")


def test_nulls_empty_long_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "а" * 200_000, "k")], "id int, t string, t_canonical string")
    got = {r["id"]: r["t_canonical"] for r in cf.with_canonical(df, ["t"]).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 200_000
    assert cf.alike_pairs(df.limit(0), "id", ["t"]).count() == 0
