"""Cutting oversized texts."""

import random
import re
import time

from conftest import rows
from pyspark.sql import functions as F

from quillon.llm import splitting as sp

def key():
    """The item is named by its id."""
    return {"item": F.col("id")}


def _text(rnd, n):
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(rnd.choice("abcdeß٣ب") for _ in range(rnd.randint(1, 14))) + rnd.choice(["", "", ".", "!", "؟", "۔"]))
        out.append(rnd.choice([" ", " ", " ", "  ", "\n", "\n\n", "\r\n \t\r\n", "\t"]))
    return "".join(out)


def _needed(t, limit):
    para = re.split(r"\r?\n[ \t]*\r?\n", t)
    sent = [s for p in para for s in re.split(r"(?<=[.!?…؟۔])\s+", p)]
    for name, parts in (("paragraph", para), ("sentence", sent), ("word", t.split())):
        if max((len(p.strip()) for p in parts), default=0) <= limit:
            return name
    return "none"


def test_profile_against_plain_splits_at_any_range_size(spark):
    rnd = random.Random(4)
    data = [(str(i), _text(rnd, rnd.randint(50, 900))) for i in range(60)] + [("x", "a" * 400), ("y", " \n\n " * 80 + "b"), ("n", None), ("e", ""), ("d", "a b " * 60), ("d", "a b " * 60)]
    df = spark.createDataFrame(data, "id string, t string")
    for limit in (60, 200):
        want = sorted({(i, _needed(t, limit)) for i, t in data if t and len(t) > limit})
        for size in (37, 250, 65_536):
            got = sp.boundary_profile(df, key(), F.col("t"), longer_than=limit, range_chars=size).select("item", sp.needed_boundary(limit)).distinct()
            assert rows(got) == want


def _check(text, pieces, limit, overlap):
    pieces = sorted(pieces)
    assert [p[0] for p in pieces] == list(range(len(pieces)))
    covered = set()
    for k, (_, s, e, piece) in enumerate(pieces):
        assert text[s:e] == piece and 0 < len(piece) <= limit
        covered |= set(range(s, e))
        if k:
            assert s > pieces[k - 1][1] and max(0, pieces[k - 1][2] - s) <= overlap
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_pieces_cover_the_text(spark):
    rnd = random.Random(8)
    data = [(str(i), _text(rnd, rnd.choice([10, 80, 700, 3000]))) for i in range(40)] + [("x", "a" * 900), ("b", "  \n "), ("n", None), ("e", "")]
    df = spark.createDataFrame(data, "id string, t string")
    for size in (300, 1000, 1_000_000):
        got = {}
        for r in sp.split_texts(df, key(), F.col("t"), limit=100, overlap=20, range_chars=size).collect():
            got.setdefault(r["item"], []).append((r["piece_no"], r["start"], r["stop"], r["piece"]))
        for i, t in data:
            if t and t.strip():
                _check(t, got[i], 100, 20)
            else:
                assert i not in got


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([("long", "word " * 100_000)], "id string, t string")
    assert sp.split_texts(df, key(), F.col("t")).count() > 300
    assert sp.split_texts(df.limit(0), key(), F.col("t")).count() == 0


def test_files_in_byte_ranges(spark, tmp_path):
    rnd = random.Random(9)
    text = _text(rnd, 9000).replace("\r", "")
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    raw = path.read_bytes()
    pieces = sorted((r["piece_no"], r["start"], r["stop"], r["piece"]) for r in sp.split_files(spark, [str(path)], limit=120, overlap=20, range_bytes=2500).collect())
    assert [p[0] for p in pieces] == list(range(len(pieces)))
    covered = bytearray(len(raw))
    for _, s, e, piece in pieces:
        assert raw[s:e].decode("utf-8") == piece and len(piece) <= 120
        covered[s:e] = b"\1" * (e - s)
    assert not bytes(b for b, c in zip(raw, covered) if not c).decode("utf-8").strip()


def test_neighbours_share_the_specified_overlap():
    rnd = random.Random(10)
    text = " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(3000))
    pieces = sp.cut_range(text, 0, len(text), True, True, 200, 40)
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    assert len(pieces) > 50
    for (_, end, _), (start, _, _) in zip(pieces, pieces[1:]):
        assert start == min(x for x in starts if x >= end - 40) < end
    assert [p[:2] for p in sp.cut_range("x" * 500, 0, 500, True, True, 200, 40)] == [(0, 200), (160, 360), (320, 500)]
    apart = sp.cut_range(text, 0, len(text), True, True, 200, 0)
    assert all(a[1] <= b[0] for a, b in zip(apart, apart[1:]))


def test_cutting_takes_linear_time():
    text = ("word and more. " * 20 + "\n\n") * 14_000  # 4.2 million characters
    began = time.perf_counter()
    pieces = sp.cut_range(text, 0, len(text), True, True, 1500, 150)
    assert time.perf_counter() - began < 15 and len(pieces) > 2800


def test_file_of_sixteen_mebibytes(spark, tmp_path):
    para = "Läufe und Wörter stehen hier. " * 30 + "\n\n"
    raw = (para * ((16 << 20) // len(para.encode()) + 1)).encode()
    path = tmp_path / "large.txt"
    path.write_bytes(raw)
    got = sorted((r["piece_no"], r["start"], r["stop"], r["piece"]) for r in sp.split_files(spark, [str(path)], range_bytes=5 << 20).collect())
    assert [g[0] for g in got] == list(range(len(got)))
    at = 0
    for _, s, e, piece in got:
        assert raw[s:e].decode() == piece and len(piece) <= 1500 and not raw[at : max(at, s)].strip()
        at = max(at, e)
    assert not raw[at:].strip()
