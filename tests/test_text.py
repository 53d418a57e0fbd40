"""Text scalars."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions import unicode as ux


@pytest.fixture(scope="module")
def one(spark):
    def run(value, f):
        df = spark.createDataFrame([(value,)], "t string")
        return df.select(f(F.col("t")).alias("x")).collect()[0]["x"]

    return run


@pytest.mark.parametrize(
    ("text", "want"),
    [("Hello,  World_now: 5", "hello world now: 5"), (None, ""), ("", ""), ("Straße ΣΟΦΟΣ", "strasse σοφοσ"), ("a--b", "a b"), ("كتاب، جديد", "كتاب جديد")],
)
def test_normalize_search(one, text, want):
    assert one(text, tx.normalize_search) == want


@pytest.mark.parametrize(("text", "want"), [("The angry reader", ["anger", "reader"]), ("what is the", ["what", "is", "the"]), (None, []), ("provision 12", ["rizq", "12"])])
def test_search_tokens(one, text, want):
    assert one(text, tx.search_tokens) == want


def test_expansion_keeps_order(one):
    assert one("patience mercy", lambda c: tx.expand_tokens(tx.words(c))) == ["patience", "sabr", "mercy", "rahmah"]


def test_trigram_similarity(spark):
    def grams(s):
        s = f"  {s}  "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    pairs = [("garden", "gardens"), ("a", "b"), ("same", "same"), ("", "x"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").select(tx.trigram_similarity(F.col("a"), F.col("b")).alias("s"))
    want = [0.0 if not a or not b else len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in pairs]
    assert [r["s"] for r in df.collect()] == pytest.approx(want)


def test_arabic_forms(one):
    text = "﴿ أَلَمْ تَرَ إِلىٰ ﴾ 12 ـة"
    assert one(text, tx.arabic_light) == "الم تر الي ة"
    assert one(text, tx.arabic_aggressive) == "الم تر الي ه"


@pytest.mark.parametrize(("html", "want"), [("<p>a &amp; b</p><p>c<br>d</p>", "a & b\nc\nd"), ("plain", "plain"), (None, ""), ("<div></div>", "")])
def test_html(one, html, want):
    assert one(html, tx.html_to_text) == want


def test_parsed_html_hides_scripts(one):
    assert one("<div>x<script>var a;</script></div><p>y &eacute;</p>", ux.parsed_html) == "x\ny é"


@pytest.mark.parametrize(
    ("text", "want"),
    [("see quran:2:255-257 now", (2, 255, 257)), ("(28:13)", (28, 13, 13)), ("surah 3 verse 10 to 7", (3, 7, 10)), ("no reference", None), (None, None)],
)
def test_references(one, text, want):
    got = one(text, tx.verse_reference)
    assert (tuple(got) if got else None) == want


def test_sentences_and_prefixes(one):
    t = "One. Two is longer!  Three? Rest"
    assert one(t, tx.sentences) == ["One.", "Two is longer!", "Three?", "Rest"]
    assert one(t, lambda c: tx.take_sentences(c, 2, 100)) == "One. Two is longer!"
    assert one(t, lambda c: tx.take_sentences(c, 5, 6)) == "One."
    assert one(t, lambda c: tx.truncate(c, 6)) == "One. T"[:5].rstrip() + "…"
    assert one("", lambda c: tx.take_sentences(c, 2, 10)) == ""


def test_snippets(one):
    t = "x" * 100 + " the garden " + "y" * 300
    got = one(t, lambda c: tx.snippet(c, "garden"))
    assert got.startswith("…") and got.endswith("…") and "garden" in got and len(got) <= 222
    assert one("short", lambda c: tx.snippet(c, "z")) == "short"


def test_citation_parts(one):
    assert one("Narrated Abu X: the body", lambda c: tx.narrator_and_body(c)["narrator"]) == "Abu X"
    assert tuple(one("Book 3, Hadith 14", tx.book_and_number)) == (3, 14)
    assert one("https://x/y:88", tx.collection_number) == 88 and one("none", tx.collection_number) is None
    assert one("Sahih (agreed)", tx.grade_label) == "sahih" and one(None, tx.grade_label) == "unknown"
    assert one("see the Great Book of Rain 7", lambda c: tx.longest_alias(c, {"book": "b", "great book of rain": "g"})) == "g"


def test_notes_and_phrases(one):
    assert one("a [[n1]] b [[n2]]", tx.inline_notes) == ["n1", "n2"] and one("a [[n1]] b", tx.without_inline_notes) == "a b"
    assert one("The  patient   page", lambda c: tx.matched_phrases(c, ["patient page", "age"])) == ["patient page"]
    assert one("abcd", tx.qgrams) == ["abc", "bcd"] and one("ab", tx.qgrams) == ["ab"] and one(" ", tx.qgrams) == []


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 100), ("", "", 100), ("abcd", "ab", 200 * 2 / 6), ("kitten", "sitting", 200 * 4 / 13)])
def test_indel_ratio(a, b, want):
    assert ux.indel_ratio(a, b) == pytest.approx(want)


def test_token_ratios():
    assert ux.token_sort_ratio("b a", "a b") == 100 and ux.token_set_ratio("a b c", "a b") == 100 and ux.token_set_ratio("", "a") == 0
    assert ux.partial_ratio("world", "hello world now") == 100 and ux.partial_ratio("", "a") == 0
