"""Results that must be whole: nothing dropped by a limit, an id or a folder of one machine."""

import random
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, index, report, retrieval, spans, state
from quillon.plans import materialize


def test_a_cluster_needs_a_shared_checkpoint_folder():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        materialize.checkpoint_dir(session)
    sc.master = "local[4]"
    assert materialize.checkpoint_dir(session)


def _greedy(items, limit=None):
    kept = []
    for q, s, a, b in sorted(items, key=lambda x: (x[0], x[2] - x[3], x[1], x[2])):
        if not any(k[0] == q and k[1] == s and k[2] <= b and k[3] >= a for k in kept):
            kept.append((q, s, a, b))
    return [k for q in {k[0] for k in kept} for k in [x for x in kept if x[0] == q][:limit]]


def test_overlap_suppression_keeps_every_survivor(spark):
    rnd = random.Random(3)
    items = sorted({(rnd.randint(1, 2), rnd.randint(1, 3), a := rnd.randint(1, 400), a + rnd.randint(0, 6)) for _ in range(700)})
    df = spark.createDataFrame([*items, (1, 1, None, 4)], "q int, s int, a int, b int")
    order = ((F.col("b") - F.col("a")).desc(), "s", "a")
    assert rows(fusion.suppress_overlaps(df, ["q"], "s", "a", "b", *order).select("q", "s", "a", "b")) == sorted(_greedy(items), key=repr)
    assert fusion.suppress_overlaps(df, ["q"], "s", "a", "b", *order, limit=5).count() == 10
    many = spark.range(3000).select(F.lit(1).alias("q"), F.lit(1).alias("s"), (F.col("id") * 2).alias("a"), (F.col("id") * 2).alias("b"))
    assert fusion.suppress_overlaps(many, ["q"], "s", "a", "b", "a").count() == 3000


def test_span_completeness_of_shuffled_repeated_spans(spark):
    have = spark.createDataFrame([(1, k) for k in (1, 2, 3, 5)], "w int, o int").repartition(3)
    asked = spark.createDataFrame([(1, 1, 3), (1, 1, 3), (1, 3, 5), (2, 1, 1), (None, 1, 1)], "w int, a int, b int").repartition(5)
    got = rows(spans.complete_spans(asked, have, ["w"], "o", "a", "b").select("w", "a", "n_found", "is_complete"))
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (1, 3, 2, False), (2, 1, 0, False), (None, 1, 0, False)], key=repr)


def test_as_of_state_of_shuffled_requests(spark):
    req = spark.createDataFrame([("a", 100, "x"), ("a", 100, "x"), ("b", 50, None), (None, 10, "n")], "k string, t long, state string").withColumn("at", F.timestamp_seconds("t")).repartition(4)
    st = spark.createDataFrame([("a", 90, 1, "s1"), ("a", 95, 2, "s2"), ("a", 101, 3, "s3"), ("b", 60, 4, "s4"), (None, 5, 5, "s5")], "k string, t long, id int, v string").withColumn("made", F.timestamp_seconds("t"))
    got = rows(state.as_of(req, st, "k", "at", "made", "id", ["v"]).select("k", "t", "state", "state_v"))
    assert got == sorted([("a", 100, "x", "s2"), ("a", 100, "x", "s2"), ("b", 50, None, None), (None, 10, "n", None)], key=repr)


def test_term_frequencies_and_grams(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["z"])], "k int, t array<string>")
    assert rows(index.postings(df, "k", F.col("t"))) == sorted([(1, "a", 1, 4), (1, "b", 3, 4), (4, "z", 1, 1)], key=repr)
    one = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,)], "t string").select(tx.qgrams(F.col("t")), tx.trigrams(F.coalesce("t", F.lit("")))).collect()
    assert [r[0] for r in one] == [["abc", "bca", "cab"], ["ab"], [], []]
    assert one[1][1] == ["  a", " ab", "ab ", "b  "]


def test_quantiles_by_running_counts(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 1, 2, 5, 9, 9, 10)] + [("h", 4), ("h", None)], "g string, v int")
    assert rows(report.exclusive_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75])) == sorted([("g", 7, 1.0, 5.0, 9.0), ("h", 1, 4.0, 4.0, 4.0)], key=repr)


def test_overlapping_occurrences_are_found(spark):
    df = spark.createDataFrame([(1, 1, "aaa"), (1, 2, "ab")], "g int, o int, t string")
    assert rows(spans.contained_spans(df, ["g"], "o", "t", "aa")) == [(1, 0, 1, 1), (1, 1, 1, 1)]
    assert rows(spans.contained_spans(df, ["g"], "o", "t", "a a")) == [(1, 2, 1, 2)]


def test_neighbours_in_blocks(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(60)], "k long, v array<double>")
    whole = retrieval.knn(df, "k", "v", df.where("k % 4 = 0"), "k", "v", 3)
    assert rows(retrieval.knn(df, "k", "v", df.where("k % 4 = 0"), "k", "v", 3, block=4)) == rows(whole)
