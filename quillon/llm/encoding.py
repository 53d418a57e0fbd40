"""Finding and restoring text whose bytes were decoded with a wrong encoding.

Three steps, after one pass that counts adjacent character pairs over all documents:

1. Every pair of adjacent characters has a score, the pointwise mutual information of its two characters in the corpus. Marginal counts are
   floored, so a pair of rare characters that the corpus does not support scores low instead of high. Stretches with the shape of a wrong
   decoding are left out of the counts, since they are what is under test and would vouch for themselves.
2. Maximum-scoring segments (all maximal ones, after Ruzzo and Tompa) over the negated scores isolate improbable runs.
3. Only inside those runs inverse mappings are tried: text encoded back with the encoding that was wrongly used and decoded as UTF-8 or with
   another one-byte encoding, up to four layers deep. A mapping is taken if the corpus finds its result clearly more probable.

The alphabet of the model is bounded by Unicode, not by data: letters and signs of the scripts the inverse mappings deal in stand for themselves, all other
characters for their block of 256. The model that is broadcast has at most ``ALPHABET ** 2`` entries, whatever the corpus size.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranges whose characters stand for themselves in the model.
OWN = [(0x0000, 0x0530), (0x0590, 0x0700), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2600), (0xFB00, 0xFB07), (0xFE70, 0xFF00), (0xFFFD, 0xFFFE)]
#: Encodings that text may have been decoded with by mistake, and those its bytes may have been in besides UTF-8.
CODECS = ["cp1252", "latin-1", "cp1256", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "koi8_r"]
#: Encodings whose upper half is letters of ordinary text, where one sequence of UTF-8 shape proves nothing.
LETTER_CODECS = {"cp1256", "cp1251", "koi8_r"}
#: Least share of all pairs that a character counts as having, and share that a pair has which was never seen; both are shares, so scores mean the same at every corpus size.
FLOOR, SMOOTH, LOST = 0.002, 1e-8, "\ufffd"
#: Sum of a text's best segment from which on its runs are isolated and tested.
SUSPECT = 5.0


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, int]:
    """Character code to symbol number (letters by their lower case); the number of symbols. Symbol 0 is a break."""
    lut = np.zeros(0x110000, np.uint16)
    n = 1
    for a, b in OWN:
        lut[a:b] = np.arange(n, n + b - a)
        n += b - a
    rest = lut == 0
    block = np.minimum(np.arange(0x110000) >> 8, 0x200)
    lut[rest] = (n + block[rest]).astype(np.uint16)
    for cp in range(0x41, 0x530):
        low = chr(cp).lower()
        if len(low) == 1:
            lut[cp] = lut[ord(low)]
    lut[0x10FFFF] = 0
    return lut, n + 0x201


ALPHABET = _alphabet()[1]


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Upper-half characters of a one-byte encoding with their bytes. Bytes it leaves undefined stand for themselves."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _cls(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@lru_cache(None)
def _utf8_shape(codec: str) -> str:
    """Pattern of one multi-byte UTF-8 sequence as it looks when decoded with ``codec``."""
    of = _bytes_of(codec)
    span = lambda a, b: _cls(c for c, x in of.items() if a <= x <= b)
    tail = span(0x80, 0xBF)
    return f"(?:{span(0xC2, 0xDF)}{tail}|{span(0xE0, 0xEF)}{tail}{{2}}|{span(0xF0, 0xF4)}{tail}{{3}})"


@lru_cache(None)
def _utf8_runs(codec: str) -> re.Pattern:
    return re.compile(_utf8_shape(codec) + "+")


@lru_cache(1)
def _shape_classes() -> list[tuple[np.ndarray, bool]]:
    """Per encoding: for each character code the length of the UTF-8 sequence it would lead (2 to 4), 1 for a tail, else 0; whether one sequence proves nothing."""
    out = []
    for codec in CODECS:
        if codec in ("latin-1", "cp1254"):
            continue
        table = np.zeros(0x110000, np.uint8)
        for c, b in [*_bytes_of(codec).items(), *(_bytes_of("latin-1").items() if codec == "cp1252" else ())]:
            table[ord(c)] = 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        out.append((table, codec in LETTER_CODECS))
    return out


@lru_cache(1)
def _upper_words() -> re.Pattern:
    """Three or more words in a row of upper-half characters only."""
    upper = _cls(set(_bytes_of("cp1252")) | set(_bytes_of("latin-1")))
    return re.compile(f"(?:(?<![^\\W_]){upper}+[\\s.,;:!?]+){{3,}}")


def _held_out(codes: np.ndarray) -> np.ndarray:
    """Marks the characters in stretches of the shape of a wrong decoding."""
    held = ((codes >= 0x80) & (codes < 0xA0)) | (codes == 0xFFFD)
    n = len(codes)
    for table, letters in _shape_classes():
        kind = table[codes]
        lead = np.flatnonzero(kind >= 2)
        need = kind[lead].astype(np.int64)
        ok = (lead + need) <= n
        lead, need = lead[ok], need[ok]
        for k in (1, 2, 3):
            keep = (k >= need) | (kind[np.minimum(lead + k, n - 1)] == 1)
            lead, need = lead[keep], need[keep]
        if letters and len(lead):
            begins = np.zeros(n + 5, bool)
            begins[lead] = True
            ends = np.zeros(n + 5, bool)
            ends[lead + need] = True
            keep = begins[lead + need] | ends[lead]
            lead, need = lead[keep], need[keep]
        for k in range(4):
            held[lead[need > k] + k] = True
    return held


def _symbols(text: str) -> np.ndarray:
    return _alphabet()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


_BREAK = "\U0010ffff"


def _without_upper_words(text: str) -> str:
    """Only a text with many upper-half characters is searched."""
    if text.isascii() or len(text.encode("latin-1", "ignore")) - len(text.encode("ascii", "ignore")) < 8:
        return text
    return _upper_words().sub(_BREAK, text)


def _count_pairs(batches):
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            texts = [_without_upper_words(t) for t in pdf["text"].iloc[at : at + 1000] if t]
            if not texts:
                continue
            codes = np.frombuffer(_BREAK.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            sym = np.where(_held_out(codes), 0, _alphabet()[0][codes])
            seen = np.flatnonzero(np.bincount(sym, minlength=1))
            small = np.zeros(ALPHABET, np.int64)
            small[seen] = np.arange(len(seen))
            s = small[sym]
            pairs = np.bincount(s[:-1] * len(seen) + s[1:])
            hit = np.flatnonzero(pairs)
            a, b = seen[hit // len(seen)], seen[hit % len(seen)]
            real = (a > 0) & (b > 0)
            yield pd.DataFrame({"a": a[real].astype(np.int32), "b": b[real].astype(np.int32), "n": pairs[hit][real]})


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """Adjacent symbol pairs ``(a, b, n)`` over all texts; at most ``ALPHABET ** 2`` rows."""
    raw = df.select(F.col(f"`{text}`").alias("text")).mapInPandas(_count_pairs, "a int, b int, n long")
    return raw.groupBy("a", "b").agg(F.sum("n").alias("n"))


@lru_cache(1)
def _layer() -> frozenset[str]:
    """Characters that a further layer of wrong decoding can consist of, and the byte order mark."""
    return frozenset(_bytes_of("cp1252")) | frozenset(_bytes_of("latin-1")) | {"\ufeff"}


class PairModel:
    """Floored pointwise mutual information of adjacent symbols."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.total = max(1.0, float(n.sum()))
        self.floor = FLOOR * self.total
        self.left = np.bincount(a, n, ALPHABET) + self.floor if len(a) else np.full(ALPHABET, self.floor)
        self.right = np.bincount(b, n, ALPHABET) + self.floor if len(a) else np.full(ALPHABET, self.floor)
        unseen = SMOOTH * self.total
        self.logn = np.full((ALPHABET, ALPHABET), np.log(unseen), np.float32)
        self.logn[a, b] = np.log(n + unseen)
        self.logl, self.logr = np.log(self.left), np.log(self.right)
        self.base = np.log(self.total)
        self.pairs: dict[str, float] = {}

    def pair(self, two: str) -> float:
        """Score of one pair, remembered."""
        found = self.pairs.get(two)
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            found = self.pairs[two] = float(self.scores(_symbols(two))[0])
        return found

    def knows(self, text: str) -> bool:
        """Whether each character is seen in the corpus or can be an intermediate layer."""
        return all(c in _layer() or self.left[s] > self.floor or self.right[s] > self.floor for c, s in zip(text, _symbols(text)))

    def scores(self, sym: np.ndarray) -> np.ndarray:
        """Score of each pair of neighbours."""
        a, b = sym[:-1], sym[1:]
        return self.logn[a, b] + self.base - self.logl[a] - self.logr[b]

    def of(self, text: str) -> np.ndarray:
        return self.scores(_symbols(text))


def maximal_segments(w: np.ndarray, least: float) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo-Tompa) of ``w`` with a sum of at least ``least``, as half-open index ranges."""
    if not len(w):
        return []
    turn = np.flatnonzero(np.diff(np.signbit(w))) + 1
    starts = np.concatenate([[0], turn])
    sums = np.add.reduceat(w, starts)
    ends = np.concatenate([turn, [len(w)]])
    stack: list[list[float]] = []  # start, end, prefix sum before, prefix sum after
    total = 0.0
    for s, e, x in zip(starts, ends, sums):
        before, total = total, total + float(x)
        if x <= 0:
            continue
        new = [s, e, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(s), int(e)) for s, e, b, a in stack if a - b >= least]


def _runs(text: str, score: np.ndarray) -> list[tuple[int, int]]:
    """Improbable runs of characters, widened to whole words."""
    out: list[list[int]] = []
    for s, e in maximal_segments(_weights(score), 3.0):
        e += 1
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if not text[s:e].isascii()]


def _cost(model: PairModel, text: str) -> float:
    if len(text) < 40:
        return -sum(model.pair(text[i : i + 2]) for i in range(len(text) - 1))
    return float(-model.of(text).sum())


@lru_cache(None)
def _leads_tails(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    of = _bytes_of(codec)
    return frozenset(c for c, b in of.items() if b >= 0xC2), frozenset(c for c, b in of.items() if b < 0xC0)


def _undo_utf8(model: PairModel, run: str, codec: str) -> tuple[str, float]:
    """``run`` with its UTF-8 sequences decoded where that is more probable, and what was gained."""
    of, gained, out, at, proof = _bytes_of(codec), 0.0, [], 0, codec not in LETTER_CODECS
    for m in _utf8_runs(codec).finditer(run):
        try:
            new = bytes(of[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not model.knows(new):
            continue
        before, after = run[max(0, m.start() - 1) : m.start()], run[m.end() : m.end() + 1]
        gain = _cost(model, before + m.group() + after) - (_cost(model, before + new + after) if new != "\ufeff" else 0.0)
        if gain > 3.0:
            out += [run[at : m.start()], new]
            at, gained = m.end(), gained + gain
            proof |= len(new) > 1 or not m.group()[-1].isalpha()
    return ("".join([*out, run[at:]]), gained) if proof else (run, 0.0)


@lru_cache(None)
def _swap(wrong: str, right: str) -> dict[int, str]:
    """Letters that differ between two one-byte encodings, as wrongly decoded and as meant."""
    back = {b: c for c, b in _bytes_of(right).items()}
    return {ord(c): back[b] for c, b in _bytes_of(wrong).items() if back[b] != c and not 0x80 <= ord(back[b]) < 0xA0}


def _undo_swap(model: PairModel, run: str, wrong: str, right: str) -> tuple[str, float]:
    """``run`` read with another one-byte encoding if nearly every changed letter then fits its neighbours better."""
    table = _swap(wrong, right)
    changed = np.array([ord(c) in table for c in run])
    new = run.translate(table)
    if len(new) != len(run):
        return run, 0.0
    better = model.of(new) - model.of(run)
    gain = np.concatenate([[0.0], better]) + np.concatenate([better, [0.0]])
    inner = changed[1:] & changed[:-1]
    if model.of(new)[changed[1:] | changed[:-1]].mean() < -1.5:
        return run, 0.0
    few = sum(c.isalpha() for c in table.values()) < 20 or right == "cp1254"
    if float((gain[changed] > 0).mean()) < 0.8 or better.sum() < 10.0 or better[changed[1:] | changed[:-1]].mean() < 0.7:
        return run, 0.0
    if not few and (inner.sum() < 3 or better[inner].mean() < 0.7):
        return run, 0.0
    return new, float(better.sum())


@lru_cache(1)
def _swaps() -> dict[str, list[tuple[str, frozenset[str]]]]:
    """For each wrong one-byte encoding the right ones it may stand for, with the letters that differ."""
    right = ["cp1256", "cp1251", "cp1254", "koi8_r", "cp1252"]
    pairs = [(w, r) for w in CODECS for r in right if w != r and {w, r} != {"cp1252", "latin-1"} and len(_swap(w, r)) > 5]
    return {w: [(r, frozenset(map(chr, _swap(w, r)))) for x, r in pairs if x == w] for w in CODECS}


def _best_utf8(model: PairModel, run: str) -> tuple[str, str, float]:
    """The most gainful decoding of a run as UTF-8 and its name; the name is empty if there is none."""
    chars = frozenset(run)
    best, how, most = run, "", 0.0
    for codec in CODECS:
        leads, tails = _leads_tails(codec)
        if chars & leads and chars & tails:
            new, gain = _undo_utf8(model, run, codec)
            if gain > most:
                best, how, most = new, f"utf-8 as {codec}", gain
    return best, how, most


def _best_swap(model: PairModel, runs: list[str]) -> tuple[list[str], str, float]:
    """The most gainful other one-byte encoding of the runs of a text, judged on all runs together that the wrong encoding can mostly have made."""
    odd = [Counter(c for c in r if c > "\x7f") for r in runs]
    best, how, most = runs, "", 0.0
    for wrong in CODECS:
        mine = [i for i, o in enumerate(odd) if sum(o[c] for c in o.keys() & _bytes_of(wrong).keys()) > 0.7 * o.total()]
        total = sum((odd[i] for i in mine), Counter())
        if total.total() < 3:
            continue
        joined = "\0".join(runs[i] for i in mine)
        for right, letters in _swaps()[wrong]:
            if sum(total[c] for c in total.keys() & letters) >= 3:
                new, gain = _undo_swap(model, joined, wrong, right)
                if gain > most:
                    best, how, most = list(runs), f"{right} as {wrong}", gain
                    for i, r in zip(mine, new.split("\0")):
                        best[i] = r
    return best, how, most


def repair(model: PairModel, text: str, layers: int = 4) -> tuple[str, list[str]]:
    """The text with its garbled runs restored where an inverse mapping was found, and the mappings used."""
    used: list[str] = []
    for _ in range(layers):
        spans, at = [], 0
        for s, e in _runs(text, model.of(text)) if len(text) > 1 else []:
            spans.append((max(at, s - 1), min(len(text), e + 1)))
            at = spans[-1][1]
        if not spans:
            break
        runs = [text[s:e] for s, e in spans]
        decoded = [_best_utf8(model, r) for r in runs]
        new, names, gain = [d[0] for d in decoded], [d[1] for d in decoded if d[1]], sum(d[2] for d in decoded)
        if not used and "\0" not in text:
            swapped, how, more = _best_swap(model, runs)
            if more > gain:
                new, names = swapped, [how]
        if not names:
            break
        used += names
        out, at = [], 0
        for (s, e), r in zip(spans, new):
            out += [text[at:s], r]
            at = e
        text = "".join([*out, text[at:]])
    return text, list(dict.fromkeys(used))


def _suspects(codes: np.ndarray, score: np.ndarray) -> np.ndarray:
    """For each text of a joined batch whether its best segment is improbable enough to be looked at.

    The best segment sum that ends at each place is the running sum less its running minimum; breaks weigh so much that no segment crosses them.
    """
    doc = np.cumsum(codes == 0x10FFFF)
    if len(codes) < 2:
        return np.zeros(int(doc[-1]) + 1 if len(doc) else 1, bool)
    brk = (codes[:-1] == 0x10FFFF) | (codes[1:] == 0x10FFFF)
    total = np.cumsum(np.where(brk, -1e4, _weights(score)))
    best = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    most = np.full(int(doc[-1]) + 1, -1.0)
    np.maximum.at(most, doc[:-1][~brk], best[~brk])
    return most >= SUSPECT


def _weights(score: np.ndarray) -> np.ndarray:
    return np.clip(-score - 1.0, -4.0, 6.0)


def _detector(shared):
    def run(batches):
        model = PairModel(*shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                texts = part["text"].tolist()
                joined = _BREAK.join(t or "" for t in texts)
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                score = model.scores(_alphabet()[0][codes]) if len(codes) > 1 else np.zeros(0)
                suspect = _suspects(codes, score)
                rows = []
                for i, (key, t) in enumerate(zip(part["key"], texts)):
                    if not t or not (suspect[i] or LOST in t):
                        continue
                    fixed, used = repair(model, t)
                    lost = LOST in t
                    if used or lost:
                        rows.append((key, fixed, ", ".join(used) or "lost", lost))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "restored", "mapping", "lossy"])

    return run


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with garbled text: ``(key, restored, mapping, lossy)``.

    ``restored`` is the text after all inverse mappings that were found; where bytes were lost (U+FFFD) it holds what could be restored and
    ``lossy`` is true. NULL and empty texts are no cases; repeated rows are each reported; an empty table gives no rows.
    """
    counts = pair_counts(df, text).toPandas()  # bounded by the alphabet, not by the corpus
    model = (counts["a"].to_numpy(np.int64), counts["b"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return rows.mapInPandas(_detector(shared), "key long, restored string, mapping string, lossy boolean")
