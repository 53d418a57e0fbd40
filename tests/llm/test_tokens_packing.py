"""Token budgets and container packing."""

import math
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import packing as pk
from quillon.llm import tokenbudget as tb

PATH = f"{tb.TOKENIZERS}/{tb.VOCABULARY}"


@pytest.fixture(scope="module")
def counter():
    return tb.PieceCounter(tb.load_ranks(PATH))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=tb.PATTERN, mergeable_ranks=tb.load_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_counts_equal_the_tokenizer(counter, encoding, text):
    assert counter.of_texts([text, None, text + text]).tolist() == [len(encoding.encode_ordinary(text)), 0, len(encoding.encode_ordinary(text + text))]


def test_long_pieces(counter, encoding):
    for t in ("a" * 5000, "ab" * 3000, "  " * 500 + "x", "تفميق" * 200):
        assert counter.of_texts([t])[0] == len(encoding.encode_ordinary(t))


def test_budget_rolls_up(spark, encoding):
    data = [(1, "S: a ", "EN", "k1", "some words here"), (2, "s:a", "eng", "k1", "some words here"), (3, "s:a", None, "k2", None), (4, "s:a", "en-GB", "k3", ""), (5, None, "fra", "k4", "des mots")]
    df = spark.createDataFrame(data, "id int, source string, lang string, item string, text string")
    keep = [tb.clean_source(F.col("source")).alias("source"), tb.clean_language(F.col("lang")).alias("lang"), F.col("item")]
    got = {(r["source"], r["lang"]): tuple(r)[2:] for r in tb.token_budget(tb.row_tokens(df, "text", keep), ["source", "lang"], "item").collect()}
    n = len(encoding.encode_ordinary("some words here"))
    assert got == {("s:a", "en"): (3, 2, 2 * n, 2, n), ("s:a", "und"): (1, 0, 0, 1, 0), (None, "fr"): (1, 1, len(encoding.encode_ordinary("des mots")), 1, len(encoding.encode_ordinary("des mots")))}
    assert tb.row_tokens(df.limit(0), "text", keep).count() == 0


def _pack(spark, sizes, capacity, **how):
    df = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    return pk.pack(df, capacity, **how).collect()


@pytest.mark.parametrize("at_once", [10, 250_000])
def test_every_item_once_and_no_overfull_container(spark, at_once):
    rnd = random.Random(6)
    sizes = [rnd.choice([0, 1, 3, rnd.randint(1, 99), rnd.randint(30, 60), 100, 101, 250, 1000]) for _ in range(300)] + [None]
    got = _pack(spark, sizes, 100, at_once=at_once, fan_in=4)
    by_key, bins, fills = {}, {}, {}
    for r in got:
        by_key.setdefault(r["key"], []).append(r)
        bins[r["bin"]] = bins.get(r["bin"], 0) + r["size"]
        fills.setdefault(r["bin"], set()).add(r["fill"])
    assert sorted(by_key) == list(range(len(sizes)))
    for k, s in enumerate(sizes):
        parts = by_key[k]
        assert sum(p["size"] for p in parts) == (s or 0) and sorted(p["chunk"] for p in parts) == list(range(len(parts)))
        assert len(parts) == max(1, math.ceil((s or 0) / 100))
    assert max(bins.values()) <= 100 and all(fills[b] == {n} for b, n in bins.items())
    assert len(bins) <= 1.03 * math.ceil(sum(s or 0 for s in sizes) / 100) + 2


def test_items_that_do_not_fit_together_and_empty_table(spark):
    assert len({r["bin"] for r in _pack(spark, [60] * 50, 100, at_once=7, fan_in=2)}) == 50
    assert pk.pack(spark.createDataFrame([], "key long, size long"), 10).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_plan_on_the_histogram_is_best_fit(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    bins, seen = {}, {s: set() for s in counts}
    for fill, at, number, first, per in pk.plan_by_fill(counts, 20):
        for r in range(at, at + number):
            assert r not in seen[fill]
            seen[fill].add(r)
            bins.setdefault(first + (r - at) // per, []).append(fill)
    assert all(len(seen[s]) == n for s, n in counts.items())
    if 0 not in sizes:
        assert sorted(map(sum, bins.values())) == sorted(f for f, _ in pk.best_fit([(s, i) for i, s in enumerate(sizes)], 20))
    assert all(sum(b) <= 20 for b in bins.values())


def test_best_fit_prefers_the_tightest_container():
    bins = pk.best_fit([(6, 0), (5, 1), (4, 2), (5, 3)], 10)
    assert sorted(f for f, _ in bins) == [10, 10]


def test_input_partitions_are_packed_and_merged(spark, monkeypatch):
    written, cut = [], pk.cut
    monkeypatch.setattr(pk, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = pk.pack(spark.createDataFrame([(i, 30) for i in range(64)], "key long, size long").repartition(16), 1000, fan_in=4).collect()
    assert written[0].select("bin").distinct().count() == 16 and len(got) == 64
    assert len({r["bin"] for r in got}) <= 3  # 1,920 in containers of 1,000


def test_merging_goes_on_to_one_group(spark):
    # one pair of ninety-two fits: rounds that merge little are no reason to stop
    assert len({r["bin"] for r in _pack(spark, [60] * 90 + [45, 55], 100, at_once=5, fan_in=2)}) == 91
