"""Cutting oversized texts into pieces under a limit, at natural boundaries where there are any.

A text (or file) is worked on in ranges. Each range sees a halo on both sides, so that whitespace runs and sentence ends across the seam are judged whole, and finds the boundaries that begin in
it. Two uses follow:

* :func:`boundary_profile` reduces each range to three numbers per kind of boundary (first cut, last cut, longest piece in between) and stitches the ranges of an item in order; no text is moved.
* :func:`split_texts` and :func:`split_files` restart at the best boundary near the start of each range. Neighbouring ranges find the same restart point from the same characters, so every range
  emits its pieces by offset on its own. Ranges of a row follow each other in its task and number their pieces by a running count; ranges of a file by a prefix sum over their piece counts.

Boundaries, from strong to weak: a blank line (LF or CRLF, it may hold spaces or tabs), whitespace after ``. ! ? … ؟ ۔``, any whitespace. Whitespace at the ends of a piece is not counted.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import cut

KINDS = ["word", "sentence", "paragraph"]
_SPACE = re.compile(r"\s+")
_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_ENDS = frozenset(".!?…؟۔")
_END_CODES = np.array([ord(c) for c in sorted(_ENDS)], np.uint32)


def separators(text: str) -> list[tuple[int, int, int]]:
    """Whitespace runs ``(start, end, kind)``; kind 2 holds a blank line, 1 follows the end of a sentence, 0 is any other."""
    out = []
    for m in _SPACE.finditer(text):
        s, e = m.span()
        kind = 2 if "\n" in m.group() and _BLANK.search(m.group()) else 1 if s and text[s - 1] in _ENDS else 0
        out.append((s, e, kind))
    return out


def _ranges(df: DataFrame, keys: list[Column], text: Column, range_chars: int, left: int, right: int) -> DataFrame:
    """One row per range: ``keys``, ``h`` (hash of the text), ``n`` (length), ``r`` (range number), ``base`` (offset of the slice), ``part`` (the slice with its halos)."""
    widest = F.array_max(F.transform(F.regexp_extract_all("t", F.lit(r"([\s\x1c-\x1f\x85\p{Z}]+)")), lambda x: F.length(x)))
    rows = df.select(*keys, text.alias("t"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("wide", F.when(F.col("n") > range_chars, F.coalesce(widest, F.lit(0))).otherwise(0))
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / range_chars).cast("int"))))
    rows = rows.withColumn("base", F.greatest(F.lit(0), F.col("r") * range_chars - left - F.col("wide")).cast("int"))
    stop = F.least(F.col("n"), (F.col("r") + 1) * range_chars + right + F.col("wide"))
    return rows.withColumn("part", F.substring("t", F.col("base") + 1, (stop - F.col("base")).cast("int"))).drop("t", "wide")


def _profile(range_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = [[None] * len(pdf) for _ in KINDS]
            last = [[None] * len(pdf) for _ in KINDS]
            inner = [[0] * len(pdf) for _ in KINDS]
            for i, (text, base, r, n) in enumerate(zip(pdf["part"], pdf["base"], pdf["r"], pdf["n"])):
                lo, hi = r * range_chars, (r + 1) * range_chars
                for s, e, kind in separators(text):
                    s, e = s + base, e + base
                    if not lo <= s < hi:
                        continue
                    if s == 0 or e == n:
                        kind = 2
                    for k in range(kind + 1):
                        if last[k][i] is None:
                            first[k][i] = s
                        else:
                            inner[k][i] = max(inner[k][i], s - last[k][i])
                        last[k][i] = e
            out = pdf.drop(columns=["part", "base"])
            for k, name in enumerate(KINDS):
                out[f"first_{name}"], out[f"last_{name}"], out[f"inner_{name}"] = pd.array(first[k], "Int64"), pd.array(last[k], "Int64"), inner[k]
            yield out

    return run


def boundary_profile(df: DataFrame, keys: dict[str, Column], text: Column, longer_than: int = 0, range_chars: int = 65_536) -> DataFrame:
    """Per distinct item and text: ``keys``, ``n`` (characters) and for each kind of boundary the longest piece that cutting there leaves.

    ``longest_paragraph`` is for cuts at blank lines only, ``longest_sentence`` for these and sentence ends, ``longest_word`` for all whitespace. Only texts of more than ``longer_than`` characters
    are looked at; NULL texts never are. Repeated rows give one row.
    """
    named = [c.alias(k) for k, c in keys.items()]
    rows = _ranges(df.where(F.length(text) > longer_than), named, text, range_chars, 2, 2)
    stats = ", ".join(f"first_{k} long, last_{k} long, inner_{k} long" for k in KINDS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("part", "base"))
    parts = rows.mapInPandas(_profile(range_chars), f"{kinds}, {stats}").dropDuplicates([*keys, "h", "n", "r"])
    item = Window.partitionBy(*keys, "h", "n").orderBy("r")
    before = item.rowsBetween(Window.unboundedPreceding, -1)
    for k in KINDS:
        seam = F.col(f"first_{k}") - F.coalesce(F.last(f"last_{k}", ignorenulls=True).over(before), F.lit(0))
        parts = parts.withColumn(f"piece_{k}", F.greatest(F.col(f"inner_{k}"), F.coalesce(seam, F.lit(0))))
    found = parts.groupBy(*keys, "h", "n").agg(*[F.greatest(F.max(f"piece_{k}"), F.col("n") - F.coalesce(F.max(f"last_{k}"), F.lit(0))).alias(f"longest_{k}") for k in KINDS])
    return found.drop("h")


def needed_boundary(limit: int) -> Column:
    """The strongest boundary that suffices for pieces of at most ``limit``: 'paragraph', 'sentence', 'word' or 'none'."""
    out = F.lit("none")
    for k in KINDS:
        out = F.when(F.col(f"longest_{k}") <= limit, k).otherwise(out)
    return out


class _Separators:
    """The whitespace runs of a text as arrays, with what is needed to find the last run of a kind before a place without scanning."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.zeros(len(codes) + 2, bool)
        space[1:-1] = _spaces()[np.minimum(codes, 0xFFFF)]
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = turn[::2], turn[1::2]
        self.kinds = (np.isin(codes[np.maximum(self.starts - 1, 0)], _END_CODES) & (self.starts > 0)).astype(np.int8) if len(turn) else np.zeros(0, np.int8)
        breaks = np.concatenate([[0], np.cumsum(codes == 0x0A)])
        for i in np.flatnonzero(breaks[self.ends] - breaks[self.starts] > 1):
            if _BLANK.search(text[self.starts[i] : self.ends[i]]):
                self.kinds[i] = 2
        at = np.arange(len(self.kinds))
        self.last = [np.maximum.accumulate(np.where(self.kinds >= k, at, -1)) if len(at) else at for k in range(3)]

    def restart(self, at: int, limit: int, n: int) -> tuple[int, int]:
        """Where a range that starts at ``at`` really starts: the end of the best separator that begins within ``limit`` of it, and where the text before ends."""
        a, b = np.searchsorted(self.starts, at), np.searchsorted(self.starts, at + limit, "right")
        b = min(b, np.searchsorted(self.ends, n))
        if a >= b:
            return at, at
        i = a + int(np.argmax(self.kinds[a:b]))
        return int(self.ends[i]), int(self.starts[i])

    def cut(self, low: int, high: int, kind: int) -> int:
        """Number of the last run of at least this kind that begins in ``[low, high]``, or -1."""
        b = int(np.searchsorted(self.starts, high, "right")) - 1
        i = int(self.last[kind][b]) if b >= 0 else -1
        return i if i >= 0 and self.starts[i] >= low else -1

    def word_start(self, want: int, cut: int) -> int:
        """The first word start in ``[want, cut]``, else ``want``."""
        i = int(np.searchsorted(self.ends, want))
        return int(self.ends[i]) if i < len(self.ends) and self.ends[i] <= cut else want


@lru_cache(1)
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x10000)])


def cut_range(text: str, lo: int, hi: int, first: bool, final: bool, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, boundary)`` of the part of ``text`` that belongs to the range ``[lo, hi)``. ``boundary`` is where the piece ends. The time follows the length of the text."""
    seps, n = _Separators(text), len(text)
    begin = 0 if first else seps.restart(lo, limit, n)[0]
    stop_at = n if final else seps.restart(hi, limit, n)[1]

    def back(cut: int, floor: int) -> int:
        """Start of the piece after ``cut``: the first word start within the overlap, else exactly the overlap before."""
        return seps.word_start(max(floor, cut - overlap), cut) if overlap else cut

    def skip(at: int) -> int:
        while at < n and text[at].isspace():
            at += 1
        return at

    tail = stop_at
    while tail > 0 and text[tail - 1].isspace():
        tail -= 1
    out: list[tuple[int, int, str]] = []
    at = skip(begin if first else back(begin, max(0, begin - overlap)))
    while at < tail:
        if tail - at <= limit:
            out.append((at, tail, "end" if final else "range"))
            break
        for kind, least in ((2, limit // 2), (1, limit // 2), (1, 1), (0, 1)):
            i = seps.cut(at + max(least, 1), min(at + limit, stop_at - 1), kind)
            if i >= 0:
                end, nxt, boundary = int(seps.starts[i]), int(seps.ends[i]), KINDS[seps.kinds[i]]
                break
        else:
            end = at + limit
            while end > at + 1 and end < n and ud.combining(text[end]):
                end -= 1
            nxt, boundary = end, "none"
        out.append((at, end, boundary))
        new = back(end, at + 1)
        at = skip(new if at < new < nxt else nxt)
    return out


def _splitter(range_chars: int, limit: int, overlap: int):
    """The ranges of a text follow each other in one task, so its pieces are numbered through by a running count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, count = None, 0
        for pdf in batches:
            rows = []
            at = {c: pdf.columns.get_loc(c) for c in ("part", "base", "r", "n")}
            keep = [i for i, c in enumerate(pdf.columns) if c not in ("part", "base", "h", "n", "r")]
            for row in pdf.itertuples(index=False, name=None):
                text, base, r, n = (row[at[c]] for c in ("part", "base", "r", "n"))
                lo, hi = r * range_chars - base, (r + 1) * range_chars - base
                if r == 0:
                    count = 0
                elif before != r - 1:
                    raise RuntimeError("the ranges of a text are out of order")
                before = r
                for s, e, boundary in cut_range(text, lo, hi, r == 0, base + hi >= n, limit, overlap):
                    rows.append((*(row[i] for i in keep), count, s + base, e + base, boundary, text[s:e]))
                    count += 1
            if rows:
                yield pd.DataFrame(rows, columns=[*(pdf.columns[i] for i in keep), "piece_no", "start", "stop", "boundary", "piece"])

    return run


def split_texts(df: DataFrame, keys: dict[str, Column], text: Column, limit: int = 1500, overlap: int = 150, range_chars: int = 1_000_000) -> DataFrame:
    """Ordered pieces of every text: ``keys``, ``piece_no``, ``start``, ``stop``, ``boundary``, ``piece``.

    No piece exceeds ``limit`` characters. Consecutive pieces share up to ``overlap`` characters, from a word start where there is one. A text within the limit is one piece; NULL, empty and blank texts give
    none. ``keys`` should name a row; repeated rows give repeated pieces.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    named = [c.alias(k) for k, c in keys.items()]
    rows = _ranges(df.where(text.isNotNull() & (text != "")), named, text, range_chars, limit + overlap, 2 * limit)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInPandas(_splitter(range_chars, limit, overlap), f"{kinds}, piece_no int, start int, stop int, boundary string, piece string")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(path: str, base: int, stop: int) -> bytes:
    system, at = _system(path)
    with system.open_input_file(at) as f:
        f.seek(base)
        return f.read(stop - base)


def split_files(spark: SparkSession, paths: list[str], limit: int = 1500, overlap: int = 150, range_bytes: int = 16 << 20) -> DataFrame:
    """Ordered pieces of UTF-8 files, read in byte ranges: ``path``, ``piece_no``, ``start`` and ``stop`` (bytes), ``boundary``, ``piece``.

    Every range with its halos finds its boundaries once; that table (offsets, no text) is written to the shared folder. A prefix sum over the ranges' piece counts numbers the pieces, and each range emits
    its pieces by offset. No task holds more than its range and two halos. Ranges start at the next whole character. ``paths`` are URIs or paths that pyarrow's file systems open.
    """
    sizes = []
    for p in paths:
        system, at = _system(p)
        sizes.append((p, int(system.get_file_info(at).size)))
    files = spark.createDataFrame(sizes, "path string, n long")
    ranges = files.where("n > 0").withColumn("r", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / range_bytes).cast("int")))).repartition("path", "r")
    halo = 4 * (2 * limit + overlap) + 4096

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, n, r in pdf[["path", "n", "r"]].itertuples(index=False, name=None):
                base, stop = max(0, r * range_bytes - halo), min(n, (r + 1) * range_bytes + halo)
                raw = _read(path, base, stop)
                skip = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), 0) if base else 0
                text = raw[skip:].decode("utf-8", "replace" if stop == n else "ignore")
                chars = lambda b: len(raw[skip : max(skip, b - base)].decode("utf-8", "ignore"))
                lo, hi = chars(r * range_bytes), chars((r + 1) * range_bytes)
                done, byte, offsets = 0, base + skip, {}
                pieces = cut_range(text, lo, hi, r == 0, (r + 1) * range_bytes >= n, limit, overlap)
                for c in sorted({x for s, e, _ in pieces for x in (s, e)}):
                    byte += len(text[done:c].encode("utf-8"))
                    done = c
                    offsets[c] = byte
                if pieces:
                    yield pd.DataFrame([(path, r, k, offsets[s], offsets[e], kind) for k, (s, e, kind) in enumerate(pieces)], columns=["path", "r", "k", "start", "stop", "boundary"])

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["start"].min())
        raw = _read(pdf["path"].iloc[0], base, int(pdf["stop"].max()))
        return pdf[["path", "piece_no", "start", "stop", "boundary"]].assign(piece=[raw[s - base : e - base].decode("utf-8", "replace") for s, e in zip(pdf["start"], pdf["stop"])])

    table = cut(ranges.mapInPandas(bounds, "path string, r int, k int, start long, stop long, boundary string"))
    before = Window.partitionBy("path").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy("path", "r").agg(F.count("*").alias("c")).select("path", "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    numbered = table.join(offsets, ["path", "r"]).select("path", "r", (F.col("k") + F.col("off")).cast("int").alias("piece_no"), "start", "stop", "boundary")
    return numbered.groupBy("path", "r").applyInPandas(emit, "path string, piece_no int, start long, stop long, boundary string, piece string")
