"""Quotation search, flows and collection scalars."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillon.functions import collections as cx
from quillon.functions import text as tx
from quillon.operators import quotes
from quillon.plans import pipelines


@pytest.fixture(scope="module")
def texts(spark):
    body = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(1, body), (2, "x y z " + body), (3, None), (4, "a b c")], "g int, t string")
    return df.withColumn("w", tx.words(F.col("t")))


def test_anchors_and_chains(spark, texts):
    q = spark.createDataFrame([(1, "d e f g h i j"), (2, "d e f g h Q i j k l m n o"), (3, "no such words in any text")], "q int, t string").withColumn("w", tx.words(F.col("t")))
    hits = quotes.anchor_hits(q, ["q"], F.col("w"), texts, ["g"], F.col("w"), 3)
    assert rows(quotes.anchored_spans(hits, ["q"], ["g"]).where("q = 1").select("g", "start_pos", "n_anchors", "is_exact")) == [(1, 3, 5, True), (2, 6, 5, True)]
    assert rows(quotes.anchor_chains(hits, ["q"], ["g"]).where("q = 2").select("g", "n_anchors", "start_pos", "end_pos")) == [(1, 8, 3, 12), (2, 8, 6, 15)]
    assert rows(quotes.anchor_votes(hits, ["q"], ["g"], 1).select("q", "g")) == [(1, 1), (2, 1)]


def test_expansion_and_stages(spark):
    seeds = spark.createDataFrame([("k", 1, 2, 3)], "k string, a int, b int, n int")
    assert rows(quotes.expanded_spans(seeds, ["k"], "a", "b", by=1, last="n")) == [("k", 1, 2), ("k", 1, 3)]
    a, b = spark.createDataFrame([(1, "x")], "q int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "q int, v string")
    assert rows(quotes.first_stage([a, b], ["q"])) == [(1, "x", 0), (2, "z", 1)]


def test_exact_passages(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "g int, n int, t string")
    q = spark.createDataFrame([(1, "b c"), (2, "a c"), (3, ""), (4, None)], "q int, t string")
    assert rows(quotes.exact_passages(q, "q", F.col("t"), df, ["g"], "n", "t", [2, 3])) == [(1, 1, 2, 3)]


def test_references(spark):
    df = spark.createDataFrame([(1, "see 2:3-5"), (2, "see 2:9"), (3, "see 9:1"), (4, "nothing"), (5, None)], "i int, t string")
    ch = spark.createDataFrame([(2, 6)], "no int, n int")
    got = {r["i"]: (r["error"], r["span_ref"]) for r in pipelines.resolve_references(df, "i", "t", ch, "no", "n").collect()}
    assert got == {1: (None, "quran:2:3-5"), 2: ("verse_out_of_range", None), 3: ("unknown_chapter", None), 4: ("no_reference", None), 5: ("no_reference", None)}
    pair = spark.createDataFrame([("2:1-9", "2:3"), ("2:1", "2:1-2"), ("x", "2:1")], "a string, b string").select(pipelines.contained_reference(F.col("a"), F.col("b")).alias("c"))
    assert [r["c"] for r in pair.collect()] == [True, False, False]


def test_ingest_and_units(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, t string")
    merged, audit = pipelines.ingest(old, new, ["k"], ["t"], "r1")
    assert merged.count() == 2 and rows(audit) == [("r1", 1, 1, 0, 0, "completed")]
    e = spark.createDataFrame([(1, "You should keep the lamp near the road. It is short. Whoever keeps it sees the reward."), (2, "tiny"), (3, None), (4, "")], "i int, t string")
    got = rows(pipelines.build_units(e, "i", "t", {"lamp": ["the lamp"]}).groupBy("i").count())
    assert got == [(1, 3), (2, 1)]


def test_flat_translations_and_keys(spark):
    v = spark.createDataFrame([("2:7", [("<p>x</p>",)]), ("2:8", [])], "verse_key string, translations array<struct<text:string>>")
    assert rows(pipelines.flat_translations(v)) == sorted([(2, 7, "x", "<p>x</p>"), (2, 8, "", None)], key=repr)
    c = pipelines.with_surrogate_keys(spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([(1, 77)], "n int, id int"), ["n"], "id")
    assert rows(c) == sorted([(1, 77), (2, None)], key=repr)


def test_evidence_and_best_units(spark):
    s = spark.createDataFrame([(1, "a", "t" * 400, 1), (1, "a", "u", 2), (1, "b", "v", 3)], "q int, ref string, t string, rank int")
    got = pipelines.evidence(s, ["q"], "ref", "t", most=1).collect()
    assert len(got) == 1 and len(got[0]["excerpt"]) == 280
    u = spark.createDataFrame([("u1", "p", 0.2), ("u1", "p", 0.9), ("u2", "p", 0.5), ("u3", "r", 0.7)], "u string, p string, s double")
    assert rows(pipelines.best_units(u, "u", "p", "s", 5)) == [("u1", "p", 0.9), ("u3", "r", 0.7)]


def test_collection_scalars(spark):
    df = spark.createDataFrame([([" a ", "", "b", "a", None], {"x": True, "y": False}, '{"p":{"q":"v"},"e":[1,2]}'), (None, None, "bad")], "a array<string>, m map<string,boolean>, j string")
    got = df.select(cx.clean_distinct(F.col("a")).alias("a"), cx.flag(F.col("m"), "x").alias("x"), cx.set_flags(F.col("m")).alias("s"), cx.json_text(F.col("j"), "$.z", "$.p.q").alias("j"), cx.json_numbers(F.col("j"), "$.e").alias("e")).collect()
    assert tuple(got[0]) == (["a", "b"], True, ["x"], "v", [1.0, 2.0]) and tuple(got[1]) == ([], False, None, None, None)
    t = spark.createDataFrame([("old:1", "Angry man", 0.5)], "i string, t string, x double")
    r = t.select(
        cx.swap_prefix(F.col("i"), "old:", "new:").alias("i"), cx.named(F.col("t"), {"angry man": "z"}).alias("n"), cx.step(F.col("x"), [(0.9, 3.0), (0.5, 2.0)], 1.0).alias("s"),
        cx.phrases_for(tx.words(F.lower("t")), {"anger": ["be calm"]}).alias("p"), cx.any_term(F.array(F.lit("a b"), F.lit("c"), F.lit("c"))).alias("q"),
    ).collect()[0]
    assert tuple(r) == ("new:1", "z", 2.0, ["be calm"], '"a b" OR c')


def test_citations(spark):
    df = spark.createDataFrame([("Great Book, book 2 hadith 7",), ("great book 15",), ("great book 3:4",), ("unknown 5",), (None,)], "t string")
    got = [r["r"] for r in df.select(tx.narration_reference(F.col("t"), {"great book": "gb"}).alias("r")).collect()]
    assert [tuple(x) if x else None for x in got] == [("gb", 2, 7), ("gb", None, 15), ("gb", 3, 4), None, None]
    s = df.limit(1).select(tx.contextual_summary([F.lit("Title")], F.lit("Body one. Two."), F.array(F.lit("a"))).alias("s"), tx.canonical_reference(F.lit("please show Sura 2 ayat 5"), ["please show"]).alias("c")).collect()[0]
    assert s["s"] == "[topics=a] Title Body one." and s["c"] == "surah 2 verse 5"
