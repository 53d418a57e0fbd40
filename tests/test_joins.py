"""Joins of exploded rows: none goes through the driver, however small the optimizer takes its sides for."""

from pyspark.sql import functions as F

from quillon.operators import fusion, quotes, similarity, spans


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def _texts(spark, key):
    # a range has a known small size, as a table has; rows of a list count as endless and are never broadcast
    return spark.range(30).select(F.col("id").alias(key), F.expr("concat('c', id % 3) AS c"), F.expr("transform(sequence(0, 19), k -> concat('w', (id * k) % 17)) AS w"))


def test_anchor_hits_are_not_broadcast(spark):
    u, e = _texts(spark, "u"), _texts(spark, "e")
    hits = quotes.anchor_hits(u, ["u"], F.col("w"), e, ["e"], F.col("w"), 5, on=["c"])
    assert _broadcasts(hits) == 0
    assert hits.where("u = 4 and e = 4 and qpos = pos").count() == 16


def test_scope_votes_are_not_broadcast(spark):
    u, e = _texts(spark, "u"), _texts(spark, "e")
    lanes = [F.col("w"), F.col("w")]
    assert _broadcasts(quotes.scope_votes(u, ["u"], lanes, e, ["e"], lanes, ["c"])) == 0


def test_alignment_is_not_broadcast(spark):
    side = lambda key, pos: _texts(spark, key).select(key, "c", F.posexplode("w").alias(pos, "token"))
    assert _broadcasts(spans.aligned_runs(side("u", "qpos"), side("e", "pos"), ["u"], ["e"], on=["c"], least=3)) == 0


def test_neighbours_are_not_broadcast(spark):
    rows = _texts(spark, "k").withColumn("apart", F.col("k") % 5)
    for short in (False, True):
        assert _broadcasts(similarity.neighbours_by_rare_tokens(rows, "k", ["c"], "apart", F.col("w"), short=short)) == 0


def test_one_edit_pairs_are_not_broadcast(spark):
    assert _broadcasts(similarity.one_edit_pairs(_texts(spark, "k"), "k", ["c"], F.col("w"))) == 0


def test_kept_spans_are_not_broadcast(spark):
    rows = spark.range(20).selectExpr("id % 4 AS q", "1 AS g", "id AS a", "id + 2 AS b", "id AS r")
    out = fusion.suppress_overlaps(rows, ["q"], "g", "a", "b", "r", limit=3)
    assert _broadcasts(out) == 0
