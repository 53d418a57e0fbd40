"""Passages of held-out test material inside a corpus.

Two sizes of windows get a 64-bit SimHash over their five-word shingles:

* item-sized windows: an item is compared as a whole with windows of its own length (lengths are graded, a window has at least 0.8 of the item's words). They find items that are there fully, as they
  stand or with scattered changes, also items of a few words.
* windows of ``window`` words, the length from which a copy of a part counts. They find parts of an item.

Fingerprints of the test items form multi-indexes: each is cut into ``blocks`` blocks, and any two fingerprints within a radius ``r`` agree on one block up to ``r // blocks`` bits, so a look-up of all
blocks under which a fingerprint is entered misses none within the radius. Candidates are verified exactly: on the words for a part, on the weighted shingles for the whole.

The corpus is never shuffled. Test items are the stated query set: an index of at most ``windows_per_block`` windows (about ten thousand items of fifty words) is broadcast and the corpus read once for it;
only a larger set is taken in several such blocks, each of which is written and its index released before the next.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import cut

SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6DC), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED), (0x8D3, 0x8FF), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))) + "]+")


def plain_words(text: str) -> list[str]:
    """Words of a text without letter case, accents and vowel marks: maximal runs of letters and digits."""
    if not text.isascii():
        text = _MARKS.sub("", ud.normalize("NFKD", text)).replace("ı", "i")
        return _WORD.findall(_MARKS.sub("", ud.normalize("NFKD", text.casefold())) if "İ" in text or "ß" in text else text.casefold())
    return _WORD.findall(text.lower())


class _Hasher(dict):
    """Word to 64-bit hash, remembered; forgets everything when it grows past a fixed size."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def window_prints(shingles: np.ndarray, per_window: list[int]) -> dict[int, np.ndarray]:
    """SimHashes of all windows of so many neighbouring shingles, for each number: bit by bit the majority, from running sums of the bits that are made once for all lengths. 0 where fewer shingles are left."""
    out = {k: np.zeros(len(shingles) + SHINGLE - 1, np.uint64) for k in per_window}
    longest = max(per_window, default=0)
    kind = np.int16 if longest < 1 << 15 else np.int32  # differences are right even where sums wrap around
    step = max(4096, 2 * longest)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step + longest - 1]
        sums = np.zeros((len(part) + 1, 64), kind)
        np.cumsum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=kind, out=sums[1:])
        for k in per_window:
            m = min(step, len(part) - k + 1)
            if m > 0:
                out[k][at : at + m] = np.packbits((sums[k : k + m] - sums[:m]) > k // 2, axis=1).view(np.uint64).ravel()
    return out


def simhashes(shingles: np.ndarray, per_window: int) -> np.ndarray:
    """SimHash of every window of ``per_window`` neighbouring shingles."""
    return window_prints(shingles, [per_window])[per_window][: max(0, len(shingles) - per_window + 1)]


class MultiIndex:
    """Fingerprints found within a Hamming radius through exact look-ups of their blocks."""

    def __init__(self, prints: np.ndarray, radius: int = 3, blocks: int = 4) -> None:
        self.prints, self.radius, self.width, self.blocks = prints, radius, 64 // blocks, blocks
        apart = [sum(1 << i for i in c) for k in range(radius // blocks + 1) for c in combinations(range(self.width), k)]
        self.tables = []
        for b in range(blocks):
            key = (self._block(prints, b)[:, None] ^ np.array(apart)[None, :]).ravel()
            order = np.argsort(key, kind="stable")
            self.tables.append(((order // len(apart)).astype(np.int32), np.searchsorted(key[order], np.arange((1 << self.width) + 1)).astype(np.int32)))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, position in the index) within the radius, each once."""
        xs, ys = [], []
        for b, (order, starts) in enumerate(self.tables):
            key = self._block(prints, b)
            many = starts[key + 1] - starts[key]
            x, at = _repeated(starts[key], many)
            y = order[at]
            near = np.bitwise_count(prints[x] ^ self.prints[y]) <= self.radius
            xs.append(x[near])
            ys.append(y[near].astype(np.int64))
        size = max(1, len(self.prints))
        both = np.unique(np.concatenate(xs) * size + np.concatenate(ys))
        return both // size, both % size


def _repeated(starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries with ``many`` neighbours from ``starts`` on: the entry of each neighbour, and its place."""
    x = np.repeat(np.arange(len(many)), many)
    return x, starts[x].astype(np.int64) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)


def graded(n: int) -> int:
    """Window length for an item of ``n`` words: all of them up to eleven, else the largest of 12, 15, 19, 24, ... (each a quarter more) within ``n``."""
    if n < 12:
        return n
    length = 12
    while (more := -(-length * 5 // 4)) <= n:
        length = more
    return length


class _Index:
    """Windows of items with their fingerprints. Equal fingerprints are entered once."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int, radius: int, blocks: int) -> None:
        """Windows of ``size`` words of the items ``(position, words)``."""
        k = min(SHINGLE, size)
        prints = [simhashes(shingle_hashes(w, k), size - k + 1) if len(w) >= size else np.zeros(0, np.uint64) for _, w in items]
        self.owner = np.repeat(np.array([i for i, _ in items], np.int64), [len(f) for f in prints])
        self.place = np.concatenate([np.arange(len(f)) for f in prints]) if prints else np.zeros(0, np.int64)
        self.unique, group = np.unique(np.concatenate(prints) if prints else np.zeros(0, np.uint64), return_inverse=True)
        self.members = np.argsort(group, kind="stable")
        self.starts = np.searchsorted(group[self.members], np.arange(len(self.unique) + 1))
        self.table = MultiIndex(self.unique, radius, blocks)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, window) within the radius."""
        x, g = self.table.find(prints)
        at, member = _repeated(self.starts[g], self.starts[g + 1] - self.starts[g])
        return x[at], self.members[member]


class _Items:
    """One block of test items: their words, fingerprints and shingle weights."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], window: int, radius: int, whole_radius: int, blocks: int) -> None:
        self.window, self.per = window, window - SHINGLE + 1
        self.ids, self.words = [i for i, _ in rows], [w for _, w in rows]
        numbered = list(enumerate(self.words))
        self.parts = _Index(numbered, window, radius, blocks)
        lengths = sorted({graded(len(w)) for w in self.words if len(w)})
        self.wholes = {size: _Index([(i, w) for i, w in numbered if graded(len(w)) == size], size, whole_radius, blocks) for size in lengths}
        self.sizes = [max(1, min(SHINGLE, len(w))) for w in self.words]
        self.shingles = [shingle_hashes(w, k) for w, k in zip(self.words, self.sizes)]
        shared = Counter(h for s in self.shingles for h in np.unique(s).tolist())
        self.weights = [np.array([1.0 / shared[h] for h in s.tolist()]) for s in self.shingles]

    def similarity(self, i: int, doc: np.ndarray) -> float:
        """Weighted share of the item's shingles that the document holds."""
        return float(self.weights[i][np.isin(self.shingles[i], shingle_hashes(doc, self.sizes[i]))].sum() / self.weights[i].sum())


def _runs(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, window: int) -> int:
    """Words of the longest common run that starts from one of the candidate windows, verified word by word."""
    best = 0
    seen: dict[int, int] = {}
    for x, y in zip(at.tolist(), place.tolist()):
        if seen.get(x - y, -1) >= x:  # inside a run of the same offset that is already measured
            continue
        n = min(len(doc) - x, len(item) - y)
        differ = np.flatnonzero(doc[x : x + n] != item[y : y + n])
        length = int(differ[0]) if len(differ) else n
        seen[x - y] = x + max(0, length - window)
        best = max(best, length)
    return best


def _scan(shared) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: _Items = shared.value
        known = _Hasher()
        for pdf in batches:
            for cut_at in range(0, len(pdf), 500):
                part = pdf.iloc[cut_at : cut_at + 500]
                keys = part["key"].tolist()
                docs = [word_hashes(plain_words(t), known) if t else np.zeros(0, np.uint64) for t in part["text"]]
                lengths = np.array([len(d) for d in docs])
                flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
                starts = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(docs)), lengths)
                room = np.repeat(starts + lengths, lengths) - np.arange(len(flat))  # words from here to the end of the document
                sizes = {items.window, *items.wholes}
                bits = window_prints(shingle_hashes(flat), [s - SHINGLE + 1 for s in sorted(sizes) if s >= SHINGLE])

                def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
                    pos = np.flatnonzero(room >= size)
                    prints = bits[size - SHINGLE + 1] if size >= SHINGLE else shingle_hashes(flat, size)
                    return pos, prints[pos]

                pos, prints = windows(items.window)
                x, m = items.parts.find(prints)
                x = pos[x]
                pair = owner[x] * len(items.ids) + items.parts.owner[m]
                order = np.lexsort((x, pair))
                x, m, pair = x[order], m[order], pair[order]
                cuts = np.flatnonzero(np.diff(pair)) + 1
                hits = {int(p[0]): (a, b) for p, a, b in zip(np.split(pair, cuts), np.split(x, cuts), np.split(m, cuts))} if len(pair) else {}
                found = set(hits)
                for size, index in items.wholes.items():
                    pos, prints = windows(size)
                    x, m = index.find(prints)
                    found |= set((owner[pos[x]] * len(items.ids) + index.owner[m]).tolist())
                rows = []
                for p in sorted(found):
                    d, i = divmod(p, len(items.ids))
                    at, m = hits.get(p, (pos[:0], pos[:0]))
                    run_words = _runs(docs[d], items.words[i], at - starts[d], items.parts.place[m], items.window)
                    rows.append((keys[d], items.ids[i], run_words, items.similarity(i, docs[d]), len(at)))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "item", "run_words", "similarity", "windows"])

    return run


def find_leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, window: int = 12, radius: int = 3, whole_radius: int = 7, blocks: int = 4, windows_per_block: int = 500_000, similarity: float = 0.8
) -> DataFrame:
    """Documents with passages of test items: ``(key, item, run_words, similarity, windows)``, one row per document and item.

    ``run_words`` is the longest run of at least ``window`` of the item's words found in order without another word between (0 if there is none), ``similarity`` the weighted share of the item's five-word
    shingles that the document holds (a shingle that n items share weighs 1/n; an item of fewer words is one shingle), ``windows`` the number of pairs of ``window``-word windows within ``radius``. A pair is
    a candidate if such a pair is there or an item-sized window lies within ``whole_radius``; it is reported if the run reaches ``window`` words or the similarity reaches ``similarity``.

    NULL, empty and wordless texts match nothing; NULL ids are left out; repeated rows are each reported; an empty set of items gives no rows. However many items there are, at most
    ``windows_per_block`` of their windows (or one item) are on the driver and in a broadcast at once.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("i"), F.col(f"`{passage}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    wanted = (F.col("run_words") >= window) | (F.col("similarity") >= similarity)
    written: list[DataFrame] = []
    block: list[tuple[int, np.ndarray]] = []
    known, size = _Hasher(), 0

    def scan(last: bool) -> None:
        nonlocal block, size
        shared = spark.sparkContext.broadcast(_Items(block, window, radius, whole_radius, blocks))
        part = rows.mapInPandas(_scan(shared), "key long, item long, run_words int, similarity double, windows int").where(wanted)
        if not last or written:
            part = cut(part)
            shared.destroy()
        written.append(part)
        block, size = [], 0

    for r in asked.toLocalIterator():
        words = word_hashes(plain_words(r["t"]), known)
        if block and size + len(words) > windows_per_block:
            scan(False)
        block.append((r["i"], words))
        size += len(words)
    scan(True)
    return reduce(DataFrame.unionByName, written)
