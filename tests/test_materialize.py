"""Helpers that keep costly columns from being computed twice, and cut lineage."""

from conftest import rows
from pyspark.sql import functions as F

from quillon.plans import materialize


def test_keep_where_equals_a_filter(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "")], "i int, t string").withColumn("n", F.size(F.split("t", " ")))
    for cond in (F.col("n") > 1, F.col("n") == 1, F.col("t").isNull(), F.lit(None).cast("boolean")):
        assert rows(materialize.keep_where(df, cond)) == rows(df.where(cond))
    assert rows(materialize.keep_where(df.limit(0), F.col("n") > 1)) == []


def test_keep_where_computes_once(spark):
    df = spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    plan = materialize.keep_where(df, F.col("h") > "8")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_exploded_equals_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i int, a array<string>")
    assert rows(materialize.exploded(df, ["i"], F.col("a"), "x", "p").select("i", "p", "x")) == rows(df.select("i", F.posexplode("a").alias("p", "x")))
    assert rows(materialize.exploded(df, ["i"], F.col("a"), "x")) == rows(df.select("i", F.explode("a").alias("x")))


def test_cut_reads_back(spark):
    df = spark.range(7).withColumn("r", F.rand(3))
    done = materialize.cut(df)
    assert rows(done) == rows(done) and done.count() == 7
    assert "Scan ExistingRDD" in done._jdf.queryExecution().executedPlan().toString()
