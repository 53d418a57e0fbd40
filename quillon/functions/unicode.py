"""Text scalars that need Python: Unicode compatibility form, HTML parsing and the fuzzy ratios. All work on Arrow batches."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCKS = frozenset("p div li br tr h1 h2 h3 h4 h5 h6 blockquote".split())


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """compatibility form with single spaces."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in _BLOCKS and tag != "br":
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def _plain(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = [" ".join(line.split()) for line in "".join(parser.parts).split("\n")]
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def parsed_html(texts: pd.Series) -> pd.Series:
    """F12 for any markup: the visible text, one line per block."""
    return texts.map(lambda t: None if t is None else _plain(t))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Share of characters, in percent, that insertions and deletions need not touch."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    """Ratio of the sorted words."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with the rest of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    return max(indel_ratio(left, right), *((indel_ratio(base, left), indel_ratio(base, right)) if both else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length in the longer one."""
    s, t = sorted((a, b), key=len)
    if not s:
        return 0.0
    if s in t:
        return 100.0
    n, best = len(s), 0.0
    for bound, at in sorted(_bounds(s, t), reverse=True):
        if bound <= best:
            break
        best = max(best, indel_ratio(s, t[max(0, at) : at + n]))
    return best


def _bounds(s: str, t: str) -> list[tuple[float, int]]:
    """Upper bound of the ratio of ``s`` with each window of ``t``, from the characters both hold, counted along."""
    n, need, have, both, out = len(s), Counter(s), Counter(), 0, []
    for at in range(1 - n, len(t)):
        if at + n <= len(t):
            c = t[at + n - 1]
            both += have[c] < need[c]
            have[c] += 1
        if at > 0:
            c = t[at - 1]
            have[c] -= 1
            both -= have[c] < need[c]
        out.append((200.0 * both / (n + min(at + n, len(t)) - max(0, at)), at))
    return out


RATIOS = {"ratio": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio}
_RATIO_TYPE = T.StructType([T.StructField(k, T.DoubleType()) for k in RATIOS])


@F.pandas_udf(_RATIO_TYPE)
def fuzzy_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """H1: all fuzzy ratios (0 to 100) of two texts; use it on shortlists only."""
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    return pd.DataFrame({k: [f(x, y) for x, y in pairs] for k, f in RATIOS.items()})


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """H5: share of matching blocks (0 to 100) of two short texts such as names."""
    return pd.Series([100.0 * SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
