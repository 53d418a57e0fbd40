"""Near-duplicate groups."""

import random
import re

import numpy as np
import pyarrow as pa
from conftest import rows

from quillon.llm import neardup as nd

WORDS = [f"w{i}" for i in range(900)]


def _texts(n=150, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.5:
            w = list(rnd.choice(out))
            for _ in range(rnd.randint(0, len(w) // 4)):
                k = rnd.randrange(len(w))
                w[k] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                rnd.shuffle(w)
            out.append(w)
        else:
            out.append(rnd.sample(WORDS, rnd.randint(20, 90)))
    return [" ".join(w) for w in out]


def _brute(data, threshold, least):
    sets = [(i, set(re.findall(r"[^\W_]+", t.lower()))) for i, t in data if t]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= threshold * len(x | y) - 1e-9}


def test_pairs_against_brute_force(spark):
    data = list(enumerate(_texts())) + [(900, None), (901, ""), (902, "one two"), (903, "  ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "id long, t string, words string")
    for threshold in (0.7, 0.8):
        assert set(rows(nd.similar_pairs(df, "id", "t", threshold=threshold, min_words=25))) == _brute(data, threshold, 25)


def test_split_groups_lose_nothing(spark, monkeypatch):
    # a small vocabulary: many sets share signatures by chance, and every group of four or more is split
    rnd = random.Random(11)
    pool = [rnd.sample(WORDS[:60], 30) for _ in range(30)]
    texts = [" ".join(rnd.sample(w, len(w) - k) + rnd.sample(WORDS[:60], k)) for w in pool for k in (0, 1, 2, 3, 5)]
    found, hot = [], nd.hot_signatures
    monkeypatch.setattr(nd, "hot_signatures", lambda *a: found.append(hot(*a)) or found[-1])
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "id long, t string").coalesce(1)
    got = set(rows(nd.similar_pairs(df, "id", "t", threshold=0.8, min_words=20, group_limit=4, hot_share=0.0)))
    assert got == _brute(data, 0.8, 20) and found[0] and max(found[0].values()) >= 2


def test_signatures_are_certain_within_the_guarantee():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(25, 140)
        a = rnd.sample(range(10**6), n)
        k = int(n * (1 - 0.8) / (1 + 0.8))
        b = a[k:] + rnd.sample(range(10**6, 2 * 10**6), k)
        sizes = np.array([len(a), len(b)])
        bands = nd.size_bands(25, 0.8, 400)
        own = [next(i for i, (lo, hi) in enumerate(bands) if lo <= s <= hi) for s in sizes]
        band = max(own)
        w = np.array(a + b, np.uint64)
        s = nd.signatures(sizes, w, band, bands[band][1], 0.8, 1, 3)
        assert (s[0] == s[1]).any()


def test_pairs_between_threshold_and_guarantee_are_certain(spark):
    # sets of 50 and 35 words with 35 in common, exactly 0.7: PartEnum at 0.8 alone misses about one in eighty
    rnd = random.Random(3)
    data = []
    for i in range(1500):
        w = [f"p{i}x{rnd.randrange(10**9)}y{k}" for k in range(50)]
        data += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(rnd.sample(w, 35)))]
    df = spark.createDataFrame(data, "id long, t string")
    got = set(rows(nd.similar_pairs(df, "id", "t", threshold=0.7, min_words=25, guarantee=0.8)))
    assert got == {(2 * i, 2 * i + 1) for i in range(1500)}


def test_signatures_meet_without_a_join(spark):
    # a self-join looks at every pair twice and at all sizes, and shuffles the rows' sketches for both sides
    reps = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(40))], "rep long, words string")
    plan = nd.candidate_links(reps, 0.7, guarantee=0.8, min_words=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_first_words_split_by_size_and_buckets_lose_nothing(spark, monkeypatch):
    # sizes over several bands from a small vocabulary: hot first words are split by size bands, and most of these again by buckets
    rnd = random.Random(23)
    texts = []
    for i in range(40):
        w = rnd.sample(WORDS[:160], rnd.randint(30, 90))
        texts += [w, rnd.sample(w, int(len(w) * 0.72) + 1), w[: int(len(w) * 0.85)] + rnd.sample(WORDS[:160], 4)]
    found, hot = [], nd.hot_signatures
    monkeypatch.setattr(nd, "hot_signatures", lambda *a: found.append(hot(*a)) or found[-1])
    data = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, t string").coalesce(1)
    got = set(rows(nd.similar_pairs(df, "id", "t", threshold=0.7, min_words=20, guarantee=0.8, group_limit=4, hot_share=0.0)))
    assert got == _brute(data, 0.7, 20) and min(found[0].values()) == 1 and max(found[0].values()) >= 2


def test_a_hot_first_word_gets_two_keys_at_most():
    sizes, sig = np.arange(30, 120), np.full(90, 77, np.uint64)
    for place, keys in ((0, 2), (17, None)):
        of, split, _ = nd._by_band(np.arange(90), sig, np.full(90, place), sizes, np.full(90, True), 0.7, 25)
        per_set = np.bincount(of)
        assert per_set.max() == 2 and per_set.min() == (keys or 1)
        groups = [set(split[of == i].tolist()) for i in range(90)]
        smaller = [i for i in range(90) if place < nd.smaller_prefix(sizes, 0.7)[i]]
        assert all(groups[i] & groups[j] for i in smaller for j in range(i, 90) if sizes[i] >= 0.7 * sizes[j])


def test_pairs_of_a_group_across_batches():
    rnd = random.Random(7)
    made = []
    for i in range(400):
        w = rnd.sample(made[rnd.randrange(i)], k) + rnd.sample(range(3000), 3) if i and rnd.random() < 0.7 and (k := 20) else rnd.sample(range(3000), rnd.randint(20, 60))
        made.append(list(dict.fromkeys(w)))
    sizes = np.array([len(w) for w in made])
    bits = nd.sketch(sizes, np.array([x for w in made for x in w], np.uint64)).view(np.int64)
    sig = np.sort(np.array([rnd.choice([1, 1, 1, 2, 3, 4, rnd.randrange(5, 99)]) for _ in made]))
    n = np.where([rnd.random() < 0.8 for _ in made], sizes, -sizes).astype(np.int32)
    table = pa.table({"sig": sig, "rep": np.arange(400), "n": n} | {f"b{i}": bits[:, i].copy() for i in range(4)})
    distance = lambda i, j: int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum())
    wanted = set()
    for i in range(400):
        for j in range(i + 1, 400):
            x, y = sorted((i, j), key=lambda k: (sizes[k], k))
            if sig[i] == sig[j] and n[x] > 0 and sizes[x] >= 0.7 * sizes[y] - 1e-9 and distance(i, j) <= (sizes[i] + sizes[j]) * 0.3 / 1.7 + 1e-9:
                wanted.add((i, j))
    for at_least in (1, 90, 10**6):
        got = [(r["a"], r["b"]) for b in nd._near(0.7, at_least)(iter(table.to_batches(max_chunksize=37))) for r in b.to_pylist()]
        assert set(got) == wanted and len(got) == len(wanted) and len(wanted) > 20


def test_sketch_never_exceeds_the_distance():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = set(rnd.sample(range(500), rnd.randint(5, 90))), set(rnd.sample(range(500), rnd.randint(5, 90)))
        bits = nd.sketch(np.array([len(a), len(b)]), np.array([*a, *b], np.uint64))
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(a ^ b)


def test_groups_one_row_per_text(spark):
    base = " ".join(WORDS[:40])
    near = " ".join(WORDS[:38] + ["zz"])
    far = " ".join(WORDS[100:150])
    df = spark.createDataFrame([(5, base), (6, base.upper()), (7, near), (8, far), (9, None), (10, "a b")], "id long, t string")
    got = {r["id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in nd.groups(df, "id", "t").collect()}
    assert got == {5: (5, 5, 1), 6: (5, 5, 1), 7: (7, 5, 1), 8: (8, 8, 0), 9: (9, 9, 0), 10: (10, 10, 0)}


def test_hot_copies_and_empty_table(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([(i, text) for i in range(40)], "id long, t string")
    assert nd.similar_pairs(df, "id", "t").count() == 40 * 39 // 2
    assert nd.similar_pairs(df.limit(0), "id", "t").count() == 0 and nd.groups(df.limit(0), "id", "t").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in nd.components(edges).collect()} == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100}
