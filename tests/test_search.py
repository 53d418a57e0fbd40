"""Edges of the composed searches: NULLs, empty texts and tables, ties, repeats, columns with clashing names."""

from conftest import rows
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import enrich, resolve, search, selection


def _docs(spark):
    data = [(1, "red garden", "a"), (2, "garden red garden", "a"), (3, "", "b"), (4, None, None), (5, "red", "a"), (5, "red", "a")]
    return spark.createDataFrame(data, "id int, text string, score string").withColumn("w", tx.words(tx.normalize_search(F.col("text"))))


def test_boolean_queries(spark):
    d = _docs(spark)
    any_ = search.bool_search(d, "id", {"f": F.col("w")}, ["red", "garden"], [("or", "f", 1.0)])
    assert sorted(r["id"] for r in any_.collect()) == [1, 2, 5, 5]
    assert sorted(r["id"] for r in search.bool_search(d, "id", {"f": F.col("w")}, ["red", "garden"], [("phrase", "f", 2.0)]).collect()) == [1, 2]
    assert sorted(r["id"] for r in search.bool_search(d, "id", {"f": F.col("w")}, ["red", "garden"], [("and", "f", 2.0)], keep=F.col("score") == "a", must_not=F.col("id") == 2).collect()) == [1]
    assert rows(search.bool_search(d, "id", {"f": F.col("w")}, [], [("or", "f", 1.0)], keep=F.col("score").isNull())) == [(4, 1.0)]
    assert len(rows(search.bool_search(d, "id", {"f": F.col("w")}, ["none"], [("or", "f", 1.0)], [(F.col("id") == 3, 4.0)], least=0))) == 6
    assert search.bool_search(d.limit(0), "id", {"f": F.col("w")}, ["red"], [("or", "f", 1.0)]).count() == 0


def test_shortlists(spark):
    d = _docs(spark).withColumn("b", F.lit(1))
    q = spark.createDataFrame([(10, "garden red garden", 1), (11, "gardens redder", 1), (12, "", 1), (13, None, 1), (14, "red", 2)], "q int, t string, b int")
    got = search.shortlist(d, "id", F.col("text"), q, "q", F.col("t"), ["b"]).select("query_id", "id", "strategy", "rank").collect()
    assert [(r["id"], r["strategy"]) for r in got if r["query_id"] == 10] == [(2, "exact")]
    assert {r["strategy"] for r in got if r["query_id"] == 11} == {"token_qgram"} and {r["query_id"] for r in got} == {10, 11}
    open_ = search.shortlist(d, "id", F.col("text"), q, "q", F.col("t"), ["b"], short_circuit=False)
    assert {r["query_id"] for r in open_.collect()} == {10, 11}
    assert search.shortlist(d.limit(0), "id", F.col("text"), q, "q", F.col("t"), ["b"]).count() == 0


def test_names_and_slugs(spark):
    known = spark.createDataFrame([(1, "Al-Baqarah"), (2, "Yasin"), (3, None), (4, "")], "k int, n string")
    asked = spark.createDataFrame([(1, "al baqarah"), (2, "ALBAQARAH"), (3, "Yaasin"), (4, "bakara"), (5, ""), (6, None), (7, "zzzzzzzz")], "q int, n string")
    assert rows(resolve.resolve_names(asked, "q", F.col("n"), known, "k", F.col("n"))) == [(1, 1, 2), (2, 1, 3), (3, 2, 4)]
    slugs = spark.createDataFrame([("a.b.general",), ("a.c.x",), ("d.e.y_general",), ("d.e.z",), (None,)], "s string")
    raw = spark.createDataFrame([("a.c.x",), ("q.q.x",), ("a.b.none",), ("a.c.none",), ("d.e.none",), ("none",), (None,)], "s string")
    got = {r["slug"]: (r["resolved"], r["layer"]) for r in resolve.resolve_slugs(raw, "s", slugs, "s").collect()}
    assert got == {"a.c.x": ("a.c.x", 1), "q.q.x": ("a.c.x", 2), "a.b.none": ("a.b.general", 3), "a.c.none": ("a.c.x", 4), "d.e.none": ("d.e.y_general", 5), "none": (None, None)}


def test_passes_take_each_result_once(spark):
    c = spark.createDataFrame([(1, "a", 1, 9), (1, "b", 2, 5), (1, "c", 3, 9), (1, "a", 4, 9), (1, "d", 5, None), (2, "x", 1, 5)], "q int, k string, rank int, s int")
    passes = [("strong", F.col("s") >= 8), ("backfill", F.col("s") >= 4)]
    got = rows(resolve.collect_in_passes(c, ["q"], "k", "rank", passes, 3).select("q", "k", "kind", "rank"))
    assert got == sorted([(1, "a", "strong", 1), (1, "c", "strong", 2), (1, "b", "backfill", 3), (2, "x", "backfill", 1)], key=repr)
    taken = spark.createDataFrame([(1, "a")], "q int, k string")
    assert rows(resolve.collect_in_passes(c, ["q"], "k", "rank", passes, 1, taken).select("q", "k")) == [(1, "c"), (2, "x")]


def test_enrichment_of_missing_texts(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "", ""), (3, "Beware of anger, do not become angry.", "On anger", "Book")], "id int, t string, c string, b string")
    got = {r["id"]: r for r in enrich.enriched(df, "id", "t", "c", "b", {"anger": ["anger", "angry"], "trust": ["trust"]}).collect()}
    assert got[1]["topics"] == [] and got[1]["central"] == 0.0 and got[1]["flags"] == [] and got[2]["answerability"] == 0.0
    assert got[3]["topics"] == ["anger"] and got[3]["labels"] == ["prohibition", "warning"] and got[3]["role"] == "direct_moral_instruction" and got[3]["central"] == 1.0  # 0.18 + 0.35 title + 0.25 + 0.18 role + 0.08 + 0.05, cut at 1
    assert enrich.enriched(df.limit(0), "id", "t", "c", "b", {"anger": ["anger"]}).count() == 0


def test_first_filled_and_fallback(spark):
    df = spark.createDataFrame([(1, 2, " "), (1, 3, "x"), (1, 1, None), (2, 1, None)], "g int, o int, t string")
    assert rows(selection.first_filled(df, ["g"], ["o"], ["t"])) == sorted([(1, 3, "x"), (2, 1, None)], key=repr)
    other = spark.createDataFrame([(2, 1, "y"), (3, 1, "z")], "g int, o int, t string")
    assert len(rows(selection.with_fallback(df, other, ["g"]))) == 5 and len(rows(selection.with_fallback(df, other, ["g"], only=True))) == 4


def test_gate_defaults():
    assert search.evidence_gate(*[F.lit(None).cast("double")] * 4, F.lit(True)) is not None
