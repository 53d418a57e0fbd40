"""Votes for groups."""

from conftest import rows
from pyspark.sql import functions as F

from quillon.operators import quotes


def test_folded_lane_and_rare_tokens_vote(spark):
    words = lambda t: t.split()
    q = [("hit", "c", "a b c d e"), ("folded", "c", "A b c d e"), ("rare", "c", "pearl the zz q r"), ("short", "c", "pearl the")]
    e = [(1, "c", "x a b c d e"), (2, "c", "the pearl"), (3, "c", "the the"), (4, "other", "pearl a b c d e")]
    frame = lambda data, ids: spark.createDataFrame([(i, c, words(t), words(t.lower())) for i, c, t in data], f"{ids}, c string, w array<string>, x array<string>")
    lanes = [F.col("w"), F.col("x")]
    got = quotes.scope_votes(frame(q, "u string"), ["u"], lanes, frame(e, "id int"), ["id"], lanes, ["c"])
    # rare: pearl is in one entry, the in two; both lanes give (2 + 1.5) / groups and 0.05 a place each
    want = [("hit", 1, 5.45, False, 1), ("folded", 1, 2.2, False, 1), ("rare", 2, 3.5 + 0.1 + 1.75 + 0.1, True, 1), ("rare", 3, 1.75 + 0.2, True, 2)]
    assert rows(got.select("u", "id", F.round("votes", 6), "lexical_fallback", "rank")) == sorted([(*w[:2], round(w[2], 6), *w[3:]) for w in want], key=repr)


def test_likely_groups(spark):
    df = spark.createDataFrame([("q", 1 if i < 2 else 2 if i < 12 else 3, 10.0 if i < 2 else 1.0 if i < 12 else 99.0, i) for i in range(14)], "q string, g int, s double, i int")
    assert rows(quotes.likely_groups(df, ["q"], "g", "s", "i")) == [("q", 1, 20.0, 1), ("q", 2, 10.0, 2)]
