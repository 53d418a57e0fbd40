"""Relational, span, retrieval and rule operators on small fixtures."""

import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, intervals, merge, report, retrieval, rules, similarity, spans, state


def _merge(data):
    out = []
    for key in sorted({d[0] for d in data}, key=repr):
        cov = sorted({n for k, a, b in data if k == key and a is not None and b is not None for n in range(min(a, b), max(a, b) + 1)})
        runs = []
        for n in cov:
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
        out += [(key, "period", a, b) for a, b in runs] + [(key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out, key=repr)


def test_interval_merge_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([1, 2, None]), rnd.randint(1, 40), rnd.choice([None, *range(1, 45)])) for _ in range(80)] + [(3, 5, 5), (3, 6, 6), (3, 9, 8), (3, 5, 5), (4, None, 3), (5, 1, 9), (5, 3, 4)]
    df = spark.createDataFrame([(k, a, b, "x", 0) for k, a, b in data], "k int, a int, b int, w string, run int")
    assert rows(intervals.coverage(df, ["k"], "a", "b")) == _merge(data)
    assert intervals.coverage(df.limit(0), ["k"], "a", "b").count() == 0
    gaps = intervals.span_gaps(intervals.merge_spans(df, ["k"], "a", "b"), ["k"])
    assert rows(gaps) == sorted(((k, a, b) for k, kind, a, b in _merge(data) if kind == "gap"), key=repr)


@pytest.mark.parametrize("width", [None, 1, 7])
def test_overlap_join(spark, width):
    rnd = random.Random(2)
    left = [(i, rnd.randint(0, 3), *sorted((rnd.randint(0, 50), rnd.randint(0, 50)))) for i in range(30)] + [(99, 1, None, 4)]
    right = [(i, rnd.randint(0, 3), *sorted((rnd.randint(0, 50), rnd.randint(0, 50)))) for i in range(30)]
    a, b = spark.createDataFrame(left, "i int, k int, a int, b int"), spark.createDataFrame(right, "j int, k int, c int, d int")
    want = sorted(((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2]) + 1) for x in left for y in right if x[2] is not None and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2]), key=repr)
    assert rows(spans.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), width).select("i", "j", "overlap")) == want


def test_windows_do_not_cross_chapters(spark):
    df = spark.createDataFrame([(c, n, f"t{c}{n}") for c, m in ((1, 1), (2, 2), (3, 3)) for n in range(1, m + 1)] + [(4, 1, "x"), (4, 3, None)], "c int, n int, t string")
    assert rows(spans.passage_windows(df, ["c"], "n", "t", [2, 3]).select("c", "start_pos", "end_pos", "text")) == [(2, 1, 2, "t21 t22"), (3, 1, 2, "t31 t32"), (3, 1, 3, "t31 t32 t33"), (3, 2, 3, "t32 t33")]


def test_fill_forward(spark):
    df = spark.createDataFrame([(1, 1, ""), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (1, 5, " "), (2, 1, None)], "g int, n int, t string")
    assert rows(spans.fill_forward_groups(df, ["g"], "n", "t")) == [(1, 1, 1, 3, 3, "a"), (1, 2, 4, 5, 2, "b")]


def test_alignment_finds_the_longest_run(spark):
    q = spark.createDataFrame([("q", i, t) for i, t in enumerate("a b c d x".split())], "q string, qpos int, token string")
    s = spark.createDataFrame([("s", i, t) for i, t in enumerate("z b c d a b y".split())], "g string, pos int, token string")
    assert rows(spans.aligned_runs(q, s, ["q"], ["g"])) == [("q", "s", 1, 1, 3)]


def test_contained_spans_map_to_rows(spark):
    df = spark.createDataFrame([(1, 1, "ab cd"), (1, 2, "ef"), (1, 3, "cd ef")], "g int, n int, t string")
    assert rows(spans.contained_spans(df, ["g"], "n", "t", "cd ef")) == [(1, 3, 1, 2), (1, 9, 3, 3)]


def test_missing_and_complete(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 5), (2, 1), (1, None)], "g int, n int")
    assert rows(spans.missing_positions(df, ["g"], "n")) == [(1, 1, 1), (1, 3, 4)]
    w = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (9, 1, 1)], "g int, a int, b int")
    assert rows(spans.complete_spans(w, df, ["g"], "n", "a", "b")) == [(1, 2, 2, 1, True), (1, 2, 3, 1, False), (9, 1, 1, 0, False)]


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "n", 0)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4), (None, "n", 0)], "k int, x string, y int")
    assert rows(merge.upsert(old, new, ["k"], ["x", "y"])) == sorted([(1, "a", 1, "unchanged"), (2, "b", 2, "updated"), (3, None, 3, "updated"), (4, "d", 4, "inserted"), (None, "n", 0, "unchanged")], key=repr)
    assert rows(merge.upsert(old, new, ["k"], ["x", "y"], fixed=["x"]).where("k = 3")) == [(3, "c", 3, "unchanged")]
    assert rows(merge.outcome_counts(merge.upsert(old, new.limit(0), ["k"], ["x"]))) == [("kept", 4)]


def test_cascade_and_json(spark):
    p = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, on boolean")
    c = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "cid int, pid int")
    left = merge.delete_cascade(p, ~F.col("on"), "id", {"c": (c, "pid")})
    assert rows(left["parents"].select("id")) == [(1,), (3,)] and rows(left["c"].select("cid")) == [(10,), (12,)]
    j = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}'), (None, '{"x":"y"}'), ("{}", None)], "o string, n string").select(merge.merge_json(F.col("o"), F.col("n")).alias("m"))
    assert [r["m"] for r in j.collect()] == [{"a": "1", "b": "3"}, {"x": "y"}, {}]


def test_run_totals(spark):
    ev = spark.createDataFrame([(1, 2, "running", 1), (1, 3, "running", 2), (1, None, "done", 3)], "run int, n int, status string, at int")
    assert rows(merge.run_totals(ev, "run", ["n"], "status", "at")) == [(1, 5, "done", 1, 3)]


@pytest.mark.parametrize("n", [2, 5, 8, 31])
def test_exclusive_quantiles(spark, n):
    rnd = random.Random(n)
    data = [rnd.choice([1, 2, 7, 9, 30]) for _ in range(n)]
    df = spark.createDataFrame([(1, v) for v in [*data, None]], "g int, v int")
    got = report.exclusive_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()[0]
    lo, hi = min(data), max(data)
    assert [got["q25"], got["q50"], got["q75"]] == pytest.approx([min(hi, max(lo, q)) for q in statistics.quantiles(data, n=4)])


def test_gate_and_rates(spark):
    df = spark.createDataFrame([("a", True, None), ("a", False, True), ("b", None, None)], "g string, x boolean, y boolean")
    m = df.groupBy("g").agg(report.rate(F.col("x")).alias("rx"), report.rate(F.col("y"), F.col("y").isNotNull()).alias("ry"))
    assert rows(report.gate(m, {"rx": 0.4, "ry": 0.5}).select("g", "rx", "ry", "passed")) == [("a", 0.5, 1.0, True), ("b", 0.0, 1.0, False)]


def test_bm25_prefers_rare_words_and_short_texts(spark):
    docs = ["rain rain", "rain cloud sun wind", "cloud", "sun sun sun", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(df, "id", {"t": (tx.words(F.col("t")), 1.0)}, ["rain", "wind"]).collect()}
    assert set(got) == {0, 1} and got[1] > 0 and got[0] > 0
    assert retrieval.bm25(df.limit(0), "id", {"t": (tx.words(F.col("t")), 1.0)}, ["rain"]).count() == 0


def test_nearest_vectors_in_blocks(spark):
    rnd = random.Random(4)
    data = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    df = spark.createDataFrame(data, "i long, v array<float>")
    q = df.where("i % 4 = 0")
    assert rows(retrieval.knn(df, "i", "v", q, "i", "v", 3, block=3)) == rows(retrieval.knn(df, "i", "v", q, "i", "v", 3))
    import numpy as np

    m = {i: np.array(v, np.float32).astype(float) for i, v in data if v and any(v)}
    for r in retrieval.knn(df, "i", "v", q, "i", "v", 3).where("rank = 1").collect():
        best = max((round(float(m[r["query_id"]] @ x / np.linalg.norm(m[r["query_id"]]) / np.linalg.norm(x)), 6), -i) for i, x in m.items() if i != r["query_id"])
        assert (r["similarity"], -r["neighbour_id"]) == best


def test_rank_fusion_and_supplement(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, k string, rank int")
    got = {r["k"]: (r["score"], r["first_lane"]) for r in fusion.reciprocal_rank_fusion([a, b], ["q"], "k").collect()}
    assert got["y"] == (round(1 / 62 + 1 / 61, 9), 0) and got["z"][1] == 1
    assert rows(fusion.supplement(a, b, ["q"], "k", 5).select("k", "lane")) == [("x", "strict"), ("y", "strict"), ("z", "relaxed")]
    assert fusion.supplement(a, b, ["q"], "k", 2).count() == 2


def test_gated_selection_and_abstention(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.8), (1, "b", 0.2), (1, "c", 0.7), (1, "d", 0.6), (2, "e", 0.1)], "q int, k string, s double")
    out = fusion.gated_selection(df, ["q"], "k", "s", [("low", F.col("s") < 0.5)], 2)
    assert rows(out.select("q", "k", "reason", "rank")) == sorted([(1, "a", None, 1), (1, "a", "duplicate", None), (1, "b", "low", None), (1, "c", None, 2), (1, "d", "beyond_limit", None), (2, "e", "low", None)], key=repr)
    assert rows(fusion.with_abstention(df, out, ["q"])) == [(1, 2, "ok"), (2, 0, "abstain")]


def test_overlap_suppression(spark):
    df = spark.createDataFrame([(1, 1, 1, 5, 9), (1, 1, 4, 8, 8), (1, 1, 6, 7, 7), (1, 2, 4, 8, 1)], "q int, g int, s int, e int, score int")
    assert rows(fusion.suppress_overlaps(df, ["q"], "g", "s", "e", F.col("score").desc()).select("g", "s")) == [(1, 1), (1, 6), (2, 4)]


def test_token_list_comparison(spark):
    data = [("a b c", "a x c", True, 1), ("a b c", "a c", True, 1), ("a b", "a b", True, 0), ("a b c", "c b a", False, 0), ("a a b", "a b", True, 1), ("", "", True, 0), ("a b c d", "a b", False, 2)]
    df = spark.createDataFrame([(x, y) for x, y, _, _ in data], "x string, y string").select(tx.words(F.col("x")).alias("a"), tx.words(F.col("y")).alias("b"))
    got = df.select(similarity.one_edit_apart(F.col("a"), F.col("b")).alias("e"), similarity.missing_count(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r["e"], r["m"]) for r in got] == [(e, m) for _, _, e, m in data]


def test_assessment_and_labels(spark):
    df = spark.createDataFrame([("what is rain",), ("a",), ("rain rain",), ("rain rain sun",), ("the quiet river turns",), (None,)], "t string")
    assert [r["m"] for r in df.select(rules.assess_text(F.col("t"))["reason"].alias("m")).collect()] == ["question_or_meta_query", "too_short", "generic_two_token_input", "short_repeated_phrase", "sufficient_signal", "empty_after_normalization"]


def test_lane_choice(spark):
    def lane(a_rank, b_rank, a_score, b_score, n, contains=False, several=True, ua=2, ub=2):
        a = {"rank": F.lit(a_rank), "score": F.lit(a_score), "unit": F.lit(ua), "contains": F.lit(contains)}
        b = {"rank": F.lit(b_rank), "score": F.lit(b_score), "unit": F.lit(ub), "several": F.lit(several)}
        return tuple(spark.range(1).select(rules.preferred_lane(a, b, F.lit(n)).alias("x")).collect()[0]["x"])

    assert lane(1, 2, 50.0, 50.0, 3) == ("b", "status") and lane(1, 1, 9.0, 90.0, 9) == ("a", "both_weak")
    assert lane(2, 2, 80.0, 85.0, 3, contains=True) == ("a", "contains_query") and lane(2, 2, 80.0, 78.0, 8) == ("b", "long_query")
    assert lane(3, 3, 50.0, 90.0, 3, ua=1) == ("b", "unit") and lane(2, 2, 70.0, 70.0, 3, several=False) == ("a", "default")


TOPICS = [rules.Topic("x.rain", "x", "Rain", ("heavy rain", "cloud"), ("On rain",), ("Weather",)), rules.Topic("x.sun", "x", "Sun", ("bright sun",), (), ()), rules.Topic("y.road", "y", "Road", ("long road",), (), ())]


def test_topics(spark):
    df = spark.createDataFrame([(1, "heavy rain and a cloud", None, None), (2, "nothing", "On rain", None), (3, "a text", None, "Weather"), (4, "plain words", None, None), (5, None, None, None)], "i int, t string, c string, b string")
    got = {r["i"]: (r["topic"], r["layer"]) for r in rules.classify_by_layers(df, "i", "t", "c", "b", TOPICS).collect()}
    assert got == {1: ("x.rain", "phrases"), 2: ("x.rain", "chapter"), 3: ("x.rain", "book"), 4: (None, "low_confidence"), 5: (None, "empty")}
    found = {r["i"]: r["topic"] for r in rules.resolve_topics(df, "i", "t", TOPICS).collect()}
    assert found[1] == "x.rain" and found[4] is None


def test_state_expiry_and_as_of(spark):
    ev = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 100, "y"), (3, "b", 0, "z"), (4, None, 100, "n")], "id int, k string, s long, p string").withColumn("at", F.timestamp_seconds("s"))
    now = lambda s: F.timestamp_seconds(F.lit(s))
    assert rows(state.latest_state(ev, "k", "at", "id", ["p"], now(150), 100).select("k", "p")) == [("a", "y")]
    assert state.latest_state(ev, "k", "at", "id", ["p"], now(200), 100).count() == 0  # expired at that very moment
    req = spark.createDataFrame([(1, "a", 0), (2, "a", 50), (3, "a", 100), (4, "a", 170), (5, "a", 500), (6, "c", 9)], "r int, k string, s long").select("r", "k", F.timestamp_seconds("s").alias("t"))
    got = state.as_of(req, ev.select("id", "k", "at", "p"), "k", "t", "at", "id", ["p"], 100)
    assert rows(got.select("r", "state_p")) == sorted([(1, None), (2, "x"), (3, None), (4, "y"), (5, None), (6, None)], key=repr)
