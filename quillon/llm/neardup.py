"""Near-duplicate texts by PartEnum signatures on word sets.

A text is its set of distinct words. Set sizes are cut into bands whose ends differ by the threshold, so two similar sets lie in one
band or in neighbouring ones; each set signs for its own band and for the next. A band's Hamming radius ``k`` fixes ``n1``
first-level parts of the hashed word domain, each of ``n2`` second-level parts, and one signature per way to choose ``n2 - k2``
of the latter. Sets within the radius agree on a whole signature by the pigeonhole principle.

Signatures meet by equality: their rows are shuffled and sorted once, and in every group a set is compared with the run of sets behind it that are not too large for it. A row carries a 256-bit parity sketch of its set;
the popcount of two sketches' XOR never exceeds the sets' Hamming distance, so false candidates are dropped on the spot, before anything is shuffled again. Survivors are checked exactly on the words.

Texts with one and the same word set are one class before the first signature is made: copies never meet each other in a join.

Signatures made of few words can be shared by a large part of all sets. Such hot signatures are found beforehand (a pass that counts within batches and sums what is frequent there), and their group is
split: a first word (below) by size bands, and what is still hot, like a hot PartEnum signature, by buckets: its sets are dealt to them, and the signature is replaced by one key per pair of buckets, so any two of its sets still meet and no key holds more than about ``group_limit`` of them.

``guarantee`` is the similarity from which on a shared PartEnum signature is certain (0.8 unless told otherwise). Below it, down to ``threshold``, a second kind of signature makes
the meeting certain: with all words in one order, rare ones first, two sets of similarity ``t`` share a word among the first ``n - ceil(t n) + 1`` of each, so these words sign as well. Of the smaller set of a pair even the first ``n - ceil(2 t n / (1 + t)) + 1`` suffice; the other words only sign for it as the larger one. No pair is left to chance.
"""

from __future__ import annotations

import math
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import cut, keep_where

_ROW = ["sig", "rep", "n", "b0", "b1", "b2", "b3"]


def words_of(text: Column) -> Column:
    """The distinct words (maximal runs of letters and digits of the lower-cased text), sorted; NULL gives no words."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(found))


def size_bands(least: int, threshold: float, most: int) -> list[tuple[int, int]]:
    """Closed bands of set sizes; the ends of a band differ at most by the threshold."""
    bands, lo = [], max(1, least)
    while lo <= most:
        hi = max(lo, math.floor(lo / threshold + 1e-9))
        bands.append((lo, hi))
        lo = hi + 1
    return bands


def radius(hi: int, similarity: float) -> int:
    """Largest Hamming distance of two sets of at most ``hi`` words with this Jaccard similarity."""
    return math.floor(2 * hi * (1 - similarity) / (1 + similarity) + 1e-9)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(sizes: np.ndarray, words: np.ndarray, band: int, hi: int, guarantee: float, k2: int, n2: int) -> np.ndarray:
    """PartEnum signatures of one band instance: a row per set. ``words`` holds the sets' 64-bit word hashes back to back."""
    n1 = -(-(radius(hi, guarantee) + 1) // (k2 + 1))
    place = _mix(words, 0x51ED + band)
    cell = (place % np.uint64(n1)).astype(np.int64) * n2 + ((place >> np.uint64(33)) % np.uint64(n2)).astype(np.int64)
    value = _mix(words, 0xA5A5)
    sums = np.zeros(len(sizes) * n1 * n2, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes) * (n1 * n2) + cell, value)
        sums = sums.reshape(len(sizes), n1, n2)
        kept = [sums[:, :, list(c)].sum(2, dtype=np.uint64) for c in combinations(range(n2), n2 - k2)]
        out = np.stack(kept, 2).reshape(len(sizes), -1)
        tag = _mix(np.arange(out.shape[1], dtype=np.uint64) + np.uint64(band << 20), 0xC0FFEE)
        return _mix(out + tag[None, :], 0x1D)


def _word_hash(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def sketch(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """256 parity bits per set, as four 64-bit numbers."""
    at = (_mix(words, 0x5EED) >> np.uint64(56)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + at, minlength=len(sizes) * 256)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, 256), axis=1).view(np.uint64)


def _banded(sizes: np.ndarray, words: np.ndarray, threshold: float, guarantee: float, least: int, k2: int, n2: int):
    """Per band instance the sets that sign for it and their signatures. Bands follow the guarantee: sets that are less similar meet by their first words."""
    ends = np.array([hi for _, hi in size_bands(least, max(threshold, guarantee), int(sizes.max()) * 2)])
    own = np.searchsorted(ends, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for b in np.unique(np.concatenate([own, own + 1])):
        pick = np.flatnonzero((own == b) | (own == b - 1))
        mine = np.concatenate([words[starts[i] : starts[i + 1]] for i in pick])
        yield pick, signatures(sizes[pick], mine, int(b), int(ends[b]), guarantee, k2, n2)


def prefix_signatures(sizes: np.ndarray, words: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the words that come first in every set, back to back, and their number per set: two sets with this Jaccard similarity share one.

    ``common`` has the sorted hashes of frequent words and their counts. The order is by count and hash, words that are not named coming first; any order that is the same for all sets keeps the certainty.
    """
    known, count = common
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    often = np.where(known[at] == words, count[at], 0) if len(known) else np.zeros(len(words), np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    ordered = words[np.lexsort((words, often, of))]
    lens = sizes - np.ceil(threshold * sizes - 1e-6).astype(np.int64) + 1
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _mix(ordered[place < np.repeat(lens, sizes)], 0x9F1E), lens


def _signed(sizes: np.ndarray, words: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None, *how):
    """Signatures in parts ``(of, sig, place)``: the set each belongs to and, of prefix signatures, the place of the word in its set; -1 of PartEnum signatures.

    There are no prefix signatures where PartEnum is certain from the threshold on (``common`` is None).
    """
    for pick, sig in _banded(sizes, words, *how):
        yield np.repeat(pick, sig.shape[1]), sig.ravel(), np.full(sig.size, -1, np.int64)
    if common is not None:
        sig, lens = prefix_signatures(sizes, words, how[0], common)
        yield np.repeat(np.arange(len(sizes)), lens), sig, np.arange(len(sig)) - np.repeat(np.cumsum(lens) - lens, lens)


def _signer(shared, common, *how):
    """Rows ``(sig, rep, n, b0..b3)``; hot signatures are split. A negative size marks a set that may only be the larger one of a pair here. The rows of a set stay together, so that the shuffle packs its sketch well."""
    threshold, _, least, *_ = how

    def run(batches):
        hot: dict[int, int] = shared.value
        keys = np.sort(np.fromiter(hot, np.uint64, len(hot)))
        dealt = np.array([hot[int(x)] for x in keys], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, ids = part["n"].to_numpy().astype(np.int64), part["rep"].to_numpy()
                words = _word_hash(part["h"])
                bits = sketch(sizes, words).view(np.int64)
                of, sig, place = (np.concatenate(x) for x in zip(*_signed(sizes, words, common.value, *how)))
                if len(keys):
                    of, sig, place = _by_band(of, sig, place, sizes, _dealt(sig, keys, dealt) == 1, threshold, least)
                    of, sig, place = _deal(of, sig, place, ids, _dealt(sig, keys, dealt))
                order = np.argsort(of.astype(np.uint16), kind="stable")
                of, sig, n = of[order], sig[order], sizes[of[order]]
                n = np.where(place[order] < smaller_prefix(n, threshold), n, -n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig.view(np.int64), ids[of], n, *bits[of].T)], names=_ROW)

    return run


def smaller_prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many first words of the smaller set of a pair suffice: both together have to share ``t / (1 + t)`` of their sizes, for the smaller one at least ``2 t / (1 + t)`` of its own."""
    return sizes - np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-6).astype(np.int64) + 1


def _dealt(sig: np.ndarray, keys: np.ndarray, dealt: np.ndarray) -> np.ndarray:
    """How often each signature is dealt: 0 if it is not hot, 1 for a first word that is split by size bands, else the number of buckets. ``keys`` is sorted."""
    at = np.minimum(np.searchsorted(keys, sig), len(keys) - 1)
    return np.where(keys[at] == sig, dealt[at], 0)


def _by_band(of: np.ndarray, sig: np.ndarray, place: np.ndarray, sizes: np.ndarray, split: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures with each one of ``split`` replaced by a key for the set's size band and, where the set may be the smaller one of a pair, one for the next band."""
    if not split.any():
        return of, sig, place
    ends = np.array([hi for _, hi in size_bands(least, threshold, int(sizes.max()) * 2)])
    row = np.concatenate([np.arange(len(sig)), np.flatnonzero(split & (place < smaller_prefix(sizes[of], threshold)))])
    band = np.searchsorted(ends, sizes[of[row]]) + (np.arange(len(row)) >= len(sig))
    with np.errstate(over="ignore"):
        return of[row], np.where(split[row], _mix(sig[row] + band.astype(np.uint64), 0xBA4D), sig[row]), place[row]


def _deal(of: np.ndarray, sig: np.ndarray, place: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures with each one of several buckets replaced by one key for each pair of buckets that the set's bucket is in."""
    times = np.maximum(buckets, 1)
    if times.max() == 1:
        return of, sig, place
    row = np.repeat(np.arange(len(sig)), times)
    other = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    mine = _mix(ids.view(np.uint64), 0xB0C5)[of[row]] % times[row].astype(np.uint64)
    with np.errstate(over="ignore"):
        pair = _mix(np.minimum(other, mine) * np.uint64(1 << 20) + np.maximum(other, mine) + sig[row], 0x5B17)
    return of[row], np.where(times[row] > 1, pair, sig[row]), place[row]


def _near(threshold: float, at_least: int = 100_000):
    """Rows ``(a, b)`` of sets that share a signature and whose sketches allow the threshold, from rows sorted by signature.

    Within a signature the sets are in order of size, so the possible partners of one are a run behind it. Batches are held until they have ``at_least`` rows and a group ends.
    """

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            sig = batch["sig"].to_numpy()
            if rows < at_least or sig[0] == sig[-1]:  # within a large group
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            yield from _near_pairs([*held[:-1], batch.slice(0, last)], threshold)
            held, rows = [batch.slice(last)], batch.num_rows - last
        if rows:
            yield from _near_pairs(held, threshold)

    return run


def _near_pairs(batches: list[pa.RecordBatch], threshold: float):
    """The pairs of whole groups."""
    sig, rep, n, *bits = (np.concatenate([b[c].to_numpy() for b in batches]) for c in _ROW)
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    if not len(shared):
        return
    size = np.abs(n).astype(np.int64)
    group = np.cumsum(new) << 32
    order = shared[np.argsort((group + size)[shared], kind="stable")]
    rep, n, size, group, bits = rep[order], n[order], size[order], group[order], [x[order].view(np.uint64) for x in bits]
    most = np.floor((size + 1e-9) / threshold).astype(np.int64)
    ends = np.where(n > 0, np.searchsorted(group + size, group + most, "right"), 0)
    apart = (1 - threshold) / (1 + threshold)
    runs = _runs(group, ends, bits, np.minimum((size + most) * apart + 1e-9, 255).astype(np.uint8))
    for some in iter(lambda: list(islice(runs, 16)), []):
        x, y = (np.concatenate(side) for side in zip(*some))
        d, allowed = np.zeros(len(x), np.int64), (size[x] + size[y]) * apart + 1e-9
        for b in bits:
            d += np.bitwise_count(b[x] ^ b[y])
        ok = (d <= allowed) & (rep[x] != rep[y])
        if ok.any():
            a, b = rep[x[ok]], rep[y[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _runs(group: np.ndarray, ends: np.ndarray, bits: list[np.ndarray], allowed: np.ndarray, at_once: int = 1 << 16, wide: int = 32):
    """Index pairs ``(x, y)``, ``x < y < ends[x]``: all of small groups, of large ones those whose sketches differ in at most ``allowed[x]`` bits.

    A large group is looked at as blocks of some rows by the run of all their partners, so nothing is gathered pair by pair; a block or a lot of small groups has about ``at_once`` pairs.
    """
    at = np.arange(len(ends))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lens = np.diff(np.append(starts, len(group)))
    large = lens >= wide
    partners = np.where(np.repeat(large, lens), 0, np.maximum(ends - at - 1, 0))
    upto = np.cumsum(partners)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once, "right")))
        k = partners[lo:hi]
        x = np.repeat(at[lo:hi], k)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi
    for start, length in zip(starts[large], lens[large]):
        left = start + np.flatnonzero(ends[start : start + length] > at[start : start + length] + 1)
        lo = 0
        while lo < len(left):
            first = left[lo] + 1
            x = left[lo : lo + min(wide, max(1, at_once // int(ends[left[lo]] - first)))]
            lo += len(x)
            run = slice(first, ends[x[-1]])
            d0, d1, d2, d3 = (np.bitwise_count(b[x, None] ^ b[run]) for b in bits)
            hit = np.flatnonzero((d0 + d1) + (d2 + d3) <= allowed[x, None])  # all 256 bits wrap to none: one candidate too many
            if len(hit):
                x, y = x[hit // (run.stop - first)], first + hit % (run.stop - first)
                ok = (y > x) & (y < ends[x])
                yield x[ok], y[ok]


def _frequent(share: float, common, *how):
    """Signatures that at least this share of a batch's sets have, with their number there; first words also by size band. ``banded`` marks what is split by size bands."""
    threshold, _, least, *_ = how

    def run(batches):
        for batch in batches:
            sizes = batch["n"].to_numpy().astype(np.int64)
            if not len(sizes):
                continue
            for of, sig, place in _signed(sizes, _word_hash(batch["h"]), common.value, *how):
                first = place[0] >= 0
                kinds = [(sig, first)] + ([(_by_band(of, sig, place, sizes, place >= 0, threshold, least)[1], False)] if first else [])
                for keys, banded in kinds:
                    found, n = np.unique(keys, return_counts=True)
                    often = n >= max(4, share * len(sizes))
                    if often.any():
                        yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often]), pa.array(np.full(often.sum(), banded))], names=["sig", "n", "banded"])

    return run


def frequent_words(sets: DataFrame, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the most frequent words and the number of sets that hold them; at most ``most``. What is not named here only counts as rare."""
    words = sets.select(F.explode("h").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()
    known, count = np.array([r["w"] for r in words], np.int64).view(np.uint64), np.array([r["n"] for r in words], np.int64)
    order = np.argsort(known)
    return known[order], count[order]


def hot_signatures(sets: DataFrame, group_limit: int, share: float, most: int, common, *how) -> dict[int, int]:
    """Signatures of large groups and the number of buckets to deal each to, or 1 for a first word to split by size bands; at most ``most``, the largest. What is not named here is only not split."""
    found = sets.mapInArrow(_frequent(share, common, *how), "sig long, n long, banded boolean").groupBy("sig", "banded").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= group_limit).orderBy(F.desc("n"), "sig").limit(most).collect()
    return {r["sig"] & 0xFFFFFFFFFFFFFFFF: 1 if r["banded"] else math.ceil(2 * r["n"] / group_limit) for r in rows}


def classes(df: DataFrame, key: str, text: str, min_words: int = 25) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: every row with the hash of its word set, and one row per distinct set.

    ``members(id, cls)``; ``reps(cls, rep, words)`` with the least id of the class and the sorted words joined by spaces. Both are written to the shared folder, so texts are read twice in all. Rows with fewer
    than ``min_words`` distinct words, NULL texts and NULL ids belong to no class.
    """
    k, t = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    rows = df.where(k.isNotNull() & (F.length(t) >= 2 * min_words - 1)).select(k.alias("id"), words_of(t).alias("w"))  # shorter texts can't hold so many words
    base = keep_where(rows, F.size("w") >= min_words).select("id", F.concat_ws(" ", "w").alias("words")).withColumn("cls", F.md5("words"))
    reps = base.groupBy("cls").agg(F.min("id").alias("rep"), F.max("words").alias("words"))
    return cut(base.select("id", "cls")), cut(reps)


def candidate_links(reps: DataFrame, threshold: float = 0.8, guarantee: float | None = None, min_words: int = 25, k2: int = 1, n2: int = 3, group_limit: int = 2000, hot_share: float = 0.002, most_hot: int = 65_536) -> DataFrame:
    """Distinct pairs ``(a, b)`` of class representatives, ``a < b``, that share a signature and whose sketches allow the threshold.

    ``reps`` is read three times and should be written. A signature that ``group_limit`` sets or more have, and at least ``hot_share`` of the sets of most batches, is split.
    """
    sets = reps.withColumn("h", F.transform(F.split("words", " "), lambda w: F.xxhash64(w))).select("rep", F.size("h").alias("n"), "h")
    how = (threshold, guarantee or max(threshold, 0.8), min_words, k2, n2)
    sc = reps.sparkSession.sparkContext
    common = sc.broadcast(frequent_words(sets) if how[1] > threshold else None)
    shared = sc.broadcast(hot_signatures(sets, group_limit, hot_share, most_hot, common, *how))
    rows = sets.mapInArrow(_signer(shared, common, *how), "sig long, rep long, n int, b0 long, b1 long, b2 long, b3 long")
    # one shuffle and one sort instead of a self-join's two, whose every pair is looked at in both orders and at all sizes
    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_near(threshold), "a long, b long").distinct()


def links(reps: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """Verified links ``(a, b, similarity)`` between class representatives: the exact Jaccard similarity of their word sets."""
    pairs = candidate_links(reps, threshold, **how)
    side = reps.select("rep", "words")
    found = pairs.join(side.select(F.col("rep").alias("a"), F.split("words", " ").alias("wa")), "a").join(side.select(F.col("rep").alias("b"), F.split("words", " ").alias("wb")), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    return found.select("a", "b", both.alias("i"), either.alias("u")).where(F.col("i") >= F.col("u") * F.lit(threshold) - 1e-9).select("a", "b", (F.col("i") / F.col("u")).alias("similarity"))


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, min_words: int = 25, **how) -> DataFrame:
    """All pairs of rows ``(id_a, id_b)``, smaller id first, whose word sets are at least ``threshold`` similar.

    The work follows the number of distinct word sets; only the last step expands classes to the rows that were asked for. NULL, empty and
    short texts are in no pair. An empty table gives no rows.
    """
    members, reps = classes(df, key, text, min_words)
    found = cut(links(reps, threshold, min_words=min_words, **how))
    several = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    same = several.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    wanted = found.select("a", "b").unionByName(same)
    ids = members.join(several.select("cls", "rep"), "cls").select("id", "rep")
    ra, rb = ids.select(F.col("rep").alias("a"), F.col("id").alias("x")), ids.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    out = wanted.join(ra, "a").join(rb, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` with the least node of each component.

    Alternates min-label exchange over the edges with pointer jumping; each round is written to the checkpoint folder, and only the number
    of changed labels comes to the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(seen, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        jump = step.join(label.select(F.col("node").alias("new"), F.col("root").alias("far")), "new", "left")
        fresh = cut(jump.select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "root"))
        changed = fresh.where("new <> root").limit(1).count()
        label = fresh.select("node", F.col("new").alias("root"))
        if not changed:
            return label


def groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, min_words: int = 25, **how) -> DataFrame:
    """One row per text ``(id, class_id, group_id, n_links)``.

    ``class_id`` is the least id with the same word set, ``group_id`` the least id of the texts connected by links, ``n_links`` the number of
    other classes linked to the row's class. Texts that are too short, NULL or empty are classes of their own with no links.
    """
    members, reps = classes(df, key, text, min_words)
    found = cut(links(reps, threshold, min_words=min_words, **how))
    ends = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = components(found).withColumnRenamed("node", "rep")
    least = members.groupBy("cls").agg(F.min("id").alias("rep"))
    placed = members.join(least, "cls").join(degree, "rep", "left").join(roots, "rep", "left")
    placed = placed.select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = df.select(F.col(f"`{key}`").cast("long").alias("id")).where(F.col("id").isNotNull())
    out = every.join(placed, "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
