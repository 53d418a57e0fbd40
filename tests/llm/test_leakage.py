"""Test passages inside a corpus."""

import random

import numpy as np
from conftest import rows

from quillon.llm import leakage as lk


def _case(seed=7):
    rnd = random.Random(seed)
    vocab = [f"Wörd{i}" for i in range(300)] + ["كِتَاب", "İzmir", "straße", "ı"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 80))
        if rnd.random() < 0.6:
            p = rnd.choice(items)[1].split()
            a = rnd.randrange(len(p))
            part = p[a : a + rnd.randint(5, 30)]
            if rnd.random() < 0.5:
                part = [x.upper() + rnd.choice(["", ",", " -"]) for x in part]
            k = rnd.randint(0, len(w))
            w[k:k] = part
        docs.append((d, rnd.choice([" ", "\n"]).join(w)))
    return docs, items


def _brute(docs, items, n=12):
    out = set()
    for i, p in items:
        w = lk.plain_words(p)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            x = lk.plain_words(t or "")
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    docs, items = _case()
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, item string, key int")
    it = spark.createDataFrame(items + [(99, None)], "item_id long, passage string")
    found = lk.find_leaks(df, "doc_id", "text", it, "item_id", "passage")
    assert set(rows(found.where("run_words >= 12").select("key", "item"))) == _brute(docs, items)
    blocks = lk.find_leaks(df, "doc_id", "text", it, "item_id", "passage", windows_per_block=200)
    assert rows(blocks.select("key", "item", "run_words")) == rows(found.select("key", "item", "run_words"))


def _similarity(items, i, doc):
    k = max(1, min(5, len(items[i])))
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    shared = lambda g: sum(g in set(grams(w, max(1, min(5, len(w))))) for w in items.values())
    weights = [(g, 1 / shared(g)) for g in grams(items[i], k)]
    there = set(grams(doc, k))
    return sum(x for g, x in weights if g in there) / sum(x for _, x in weights)


def test_whole_items_of_any_length_and_with_changes(spark):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    items = {i: rnd.choices(vocab, k=n) for i, n in enumerate([1, 2, 3, 5, 7, 11, 12, 14, 30, 31, 60, 120, 300])}
    docs = {}
    for i, w in items.items():
        around = rnd.choices(vocab, k=40)
        docs[i] = around[:20] + w + around[20:]
        if len(w) >= 60:
            changed = list(w)
            changed[len(w) // 2] = "other"
            docs[100 + i] = around[:7] + changed + around[7:]
            docs[200 + i] = around[:7] + [x for k, x in enumerate(w) if k % 8] + around[7:]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(500, ""), (501, "?!")], "item_id long, passage string")
    got = {(r["key"], r["item"]): r["similarity"] for r in lk.find_leaks(df, "doc_id", "text", it, "item_id", "passage").collect()}
    want = {(d, i) for d in docs for i in items if _similarity(items, i, docs[d]) >= 0.8}
    assert {(i, i) for i in items} | {(100 + i, i) for i in items if len(items[i]) >= 60} <= want == set(got)
    assert all(abs(_similarity(items, i, docs[d]) - s) < 1e-9 for (d, i), s in got.items())


def test_words_ignore_form():
    assert lk.plain_words("Ça, VA-t'il?  كِتَابٌ") == lk.plain_words("ca va t il كتاب")
    assert lk.plain_words("ISPARTA ırmak") == lk.plain_words("isparta IRMAK")


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    asked = prints[:200].copy()
    for k in range(200):
        for bit in rng.choice(64, k % 5, replace=False):
            asked[k] ^= np.uint64(1 << int(bit))
    x, y = lk.MultiIndex(prints, 3, 4).find(asked)
    near = np.bitwise_count(asked[:, None] ^ prints[None, :]) <= 3
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(near))))
    for k in range(200):
        for bit in rng.choice(64, 4, replace=False):
            asked[k] ^= np.uint64(1 << int(bit))
    x, y = lk.MultiIndex(prints, 7, 4).find(asked)
    near = np.bitwise_count(asked[:, None] ^ prints[None, :]) <= 7
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(near))))


def test_empty_tables_and_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 13)], "item_id long, passage string")
    assert rows(lk.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").select("key", "item")) == [(1, 1)]
    assert lk.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert lk.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
