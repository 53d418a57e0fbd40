"""Neighbours of passages, through the registered query."""

import pytest
from conftest import rows

VERSES = "id int, work_id int, surah_no int, ayah_no int, language_code string, text_display string, text_normalized string, updated_at timestamp"


def write_verses(spark, folder, data):
    """``data``: work, chapter, verse, text; all of one language. Ids count from 1."""
    table = [(i, w, s, a, "en", t, t, None) for i, (w, s, a, t) in enumerate(data, 1)]
    spark.createDataFrame(table, VERSES).write.parquet(f"{folder}/quran_ayahs.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """Passages similar only as a whole: two verses share two words each with two others; work 2 and 3 hold reprints of a verse."""
    data = [(1, 1, 1, "one two x1"), (1, 1, 2, "three four x2"), (1, 2, 5, "one two y1"), (1, 2, 6, "three four y2")]
    data += [(w, s, 1, "red green blue black white") for w in (2, 3) for s in (1, 2)]
    return write_verses(spark, tmp_path_factory.mktemp("v"), data)


def test_passages_get_neighbours(spark, passages):
    import __spark_entry__ as entry

    got = entry.queries()["j09_passage_neighbours"](spark, passages).select("work_id", "window_size", "surah_no", "start_pos", "neighbour_surah_no", "neighbour_start_pos", "rank", "shared")
    twos = [(1, 2, 1, 1, 2, 5, 1, 4), (1, 2, 2, 5, 1, 1, 1, 4)]
    assert rows(got) == sorted([*twos, *[(w, 1, s, 1, 3 - s, 1, 1, 5) for w in (2, 3) for s in (1, 2)]], key=repr)


def test_passages_against_sql(spark, passages):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    for folder in (passages, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW quran_ayahs AS SELECT * FROM '{folder}/quran_ayahs.parquet{'/*.parquet' if folder == passages else ''}'")
        want = con.sql(entry.oracle_sql()["j09_passage_neighbours"])
        got = entry.queries()["j09_passage_neighbours"](spark, folder)
        assert got.columns == want.columns and got.count() > 0
        number = lambda r: tuple(float(x) for x in r)
        assert sorted(map(number, got.collect())) == sorted(map(number, want.fetchall()))


def test_one_edit_partner_below_the_ranks_is_found(spark, tmp_path):
    import __spark_entry__ as entry

    text, partner = "one two three four five six", "one two three four five seven"
    data = [(1, 1, 1, text), (1, 1, 9, partner), *[(w, 2, 1, text) for w in range(2, 16)], (1, 3, 1, partner), (1, 4, 1, "a b c"), (1, 5, 1, "a b d"), (1, 6, 1, "one two three four k l m n o")]
    got = entry.queries()["h8_one_edit_verses"](spark, write_verses(spark, tmp_path, data))
    first = {r["neighbour_id"]: (r["missing"], r["one_edit"], r["relaxed_parallel"]) for r in got.where("id = 1").collect()}
    assert first == {2: (1, True, True), **{i: (0, True, True) for i in range(3, 17)}, 17: (1, True, True)}
    assert got.where("id IN (18, 19)").count() == 0 and got.where("id = 3 AND neighbour_id BETWEEN 4 AND 16").count() == 0
    last = {r["neighbour_id"]: (r["missing"], r["one_edit"], r["relaxed_parallel"]) for r in got.where("id = 20").collect()}
    assert len(last) == 12 and set(last.values()) == {(5, False, False)}


def test_one_edit_pairs_equal_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from quillon.operators import similarity

    rnd = random.Random(7)
    data = [(i, rnd.randint(0, 1), [rnd.choice("ab") for _ in range(rnd.randint(0, 6))]) for i in range(120)]
    df = spark.createDataFrame(data, "i int, k int, t array<string>")
    cuts = lambda x: [x[:j] + x[j + 1 :] for j in range(len(x))]
    near = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True)) <= 1 if len(x) == len(y) else x in cuts(y) or y in cuts(x)
    want = [(a[1], a[0], b[0]) for a in data for b in data if a[0] != b[0] and a[1] == b[1] and len(a[2]) >= 4 and near(a[2], b[2])]
    assert rows(similarity.one_edit_pairs(df, "i", ["k"], F.col("t"))) == sorted(want, key=repr)


def test_neighbours_are_the_same_where_tokens_travel(spark):
    import random

    from pyspark.sql import functions as F

    from quillon.operators import similarity

    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 1), rnd.randint(0, 3), [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 12))]) for i in range(150)]
    df = spark.createDataFrame(data, "i int, k int, s int, t array<string>")
    one, two = (similarity.neighbours_by_rare_tokens(df, "i", ["k"], "s", F.col("t"), short=s) for s in (False, True))
    assert rows(one) == rows(two) and one.count() > 150
