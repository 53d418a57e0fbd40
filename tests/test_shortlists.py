"""Shortlists at size: shared terms and rows of one wording are not moved as pairs, and buckets change no result."""

from conftest import rows
from pyspark.sql import functions as F

from quillon.operators import search


def _texts(spark, n, key, text):
    return spark.range(n).select(F.col("id").cast("int").alias(key), F.lit("b").alias("b"), F.expr(text).alias("t"))


def _written(spark, run):
    """Records that the stages of ``run`` write for a shuffle."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_shared_terms_are_not_moved(spark):
    """400 rows and 40 queries share ten words: 16,000 pairs with 60 terms each; what is moved grows with rows and results."""
    same = "'one two three four five six seven eight nine ten'"
    d, q = _texts(spark, 400, "id", f"concat({same}, ' r', id)"), _texts(spark, 40, "q", f"concat({same}, ' q', id)")
    got = []
    moved = _written(spark, lambda: got.extend(search.shortlist(d, "id", F.col("t"), q, "q", F.col("t"), ["b"], 5, short_circuit=False).collect()))
    assert len(got) == 200 and {r["strategy"] for r in got} == {"token_qgram"}
    assert moved < 16_000


def _mixed(spark):
    """Copies of wordings, short and long texts, few and many candidates, rows that share grams only."""
    words = "concat_ws(' ', transform(sequence(0, id % 7), k -> concat('word', (id * k + id % 3) % 11)))"
    d = _texts(spark, 200, "id", f"CASE WHEN id % 9 = 0 THEN concat('ab', id % 4) WHEN id % 10 = 0 THEN '' ELSE {words} END").withColumn("b", F.when(F.col("id") % 13 != 0, F.col("id") % 2))
    return d, d.where("id % 3 = 0").select(F.col("id").alias("q"), "b", F.concat("t", F.when(F.col("id") % 2 == 0, " x").otherwise("")).alias("t"))


def test_buckets_change_nothing(spark, monkeypatch):
    d, q = _mixed(spark)
    run = lambda short: rows(search.shortlist(d, "id", F.col("t"), q, "q", F.col("t"), ["b"], 7, short_circuit=short))
    whole = [run(short) for short in (False, True)]
    monkeypatch.setattr(search, "BUCKET_TEXTS", 9)
    monkeypatch.setattr(search, "BUCKET_QUERIES", 4)
    assert [run(short) for short in (False, True)] == whole
    assert len({r[1] for r in whole[0]}) > 30 and len(whole[0]) > 200 and all(r[0] is not None for r in whole[0])


def test_copies_of_one_wording_are_not_moved_as_pairs(spark):
    """100 queries have the form of each of 300 rows: 30,000 exact pairs, of which 500 are asked for."""
    d, q = _texts(spark, 300, "id", "'one two three'"), _texts(spark, 100, "q", "'one two three'")
    got = []
    moved = _written(spark, lambda: got.extend(search.shortlist(d, "id", F.col("t"), q, "q", F.col("t"), ["b"], 5).collect()))
    assert {(r["query_id"], r["rank"], r["id"], r["strategy"]) for r in got} == {(k, i + 1, i, "exact") for k in range(100) for i in range(5)}
    assert moved < 10_000
