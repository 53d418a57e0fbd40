"""Readers, sinks and the streaming state store."""

import json
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillon.operators.state import latest_state
from quillon.sources import readers, sinks
from quillon.streaming import sessions


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_mark_and_last_row_wins(spark, tmp_path):
    p = _write(tmp_path / "a.csv", '﻿k,t\n1,"x, ""q"""\n1,y\n2,\n')
    assert rows(readers.read_csv(spark, p, "k int, t string", key=["k"])) == sorted([(1, "y"), (2, None)], key=repr)
    assert readers.read_optional_csv(spark, str(tmp_path / "no.csv"), "k int, a string, b string", ["a", "b"]).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak")], "k int, t string")
    sinks.write_csv(df, str(tmp_path / "o"), ["k", "t"])
    assert rows(readers.read_csv(spark, str(tmp_path / "o"), "k int, t string")) == rows(df)


def test_jsonl_skips_incomplete_rows(spark, tmp_path):
    p = _write(tmp_path / "a.jsonl", '{"a":1,"b":["x"]}\n\nnot json\n{"b":["y"]}\n')
    assert rows(readers.read_jsonl(spark, p, "a int, b array<string>", ["a"], tolerate=True)) == [(1, ["x"])]
    assert rows(readers.unreadable_lines(spark, p, "a int, b array<string>")) == [("not json",)]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, p, "a int, b array<string>").collect()


def test_optional_files_are_looked_for_on_their_own_file_system(spark, tmp_path):
    p = _write(tmp_path / "here.csv", "k,a\n1, x \n")
    assert rows(readers.read_optional_csv(spark, f"file://{p}", "k int, a string", ["a"])) == [(1, " x ", "x")]
    with pytest.raises(Exception, match="(?i)scheme"):
        readers.read_optional_csv(spark, "nosuchfs://host/a.csv", "k int, a string", ["a"])
    _write(tmp_path / "v1" / "a.csv", "x")
    assert readers.read_bundle(f"file://{tmp_path}", "v1", ["a.csv"]) == {"a.csv": f"file://{tmp_path}/v1/a.csv"}
    with pytest.raises(FileNotFoundError):
        readers.read_bundle(f"file://{tmp_path}", "v1", ["b.csv"], require=True)


def test_verse_xml(spark, tmp_path):
    p = _write(tmp_path / "q.xml", '<quran><sura index="1" name="A"><aya index="1" text="x" bismillah="b"/><aya index="2" text="y"/></sura><sura index="2" name="B"><aya index="1" text="z"/></sura></quran>')
    assert rows(readers.read_verse_xml(spark, p)) == sorted([(1, 1, "A", "x", "b"), (1, 2, "A", "y", None), (2, 1, "B", "z", None)], key=repr)


def test_chapter_files_report_issues(spark, tmp_path):
    row = lambda c, n: {"id": n, "resource_id": 5, "verse_key": f"{c}:{n}", "language_id": 1, "slug": "s", "text": "t"}
    _write(tmp_path / "c" / "chapter_1.json", json.dumps({"resource_id": 5, "chapter_number": 1, "count": 2, "tafsirs": [row(1, 1), row(1, 2)]}))
    _write(tmp_path / "c" / "chapter_2.json", json.dumps({"resource_id": 5, "chapter_number": 2, "count": 3, "tafsirs": [row(2, 1), row(2, 3)]}))
    _write(tmp_path / "c" / "chapter_3.json", json.dumps({"resource_id": 5, "chapter_number": 4, "count": 0, "tafsirs": []}))
    got = {r["file"]: r["issues"] for r in readers.read_chapter_files(spark, str(tmp_path / "c")).select("file", "issues").distinct().collect()}
    assert got["chapter_1.json"] == [] and got["chapter_2.json"] == ["count", "contiguous"] and "file_name" in got["chapter_3.json"] and "not_empty" in got["chapter_3.json"]


def test_keyed_and_delimited(spark, tmp_path):
    p = _write(tmp_path / "k.json", '{"2:1":{"t":"a"},"1:10":{"t":"b"},"1:2":{"t":" "}}')
    assert rows(readers.read_keyed_json(spark, p)) == [(1, 10, "b"), (2, 1, "a")]
    p = _write(tmp_path / "d.txt", "# c\n1|2|text here\n\n")
    assert rows(readers.read_delimited(spark, p)) == [(1, 2, "text here")]
    with pytest.raises(Exception, match="malformed line"):
        readers.read_delimited(spark, _write(tmp_path / "e.txt", "bad\n")).collect()


def test_book_and_flat_files(spark, tmp_path):
    book = {
        "id": 3, "metadata": {"english": {"title": "E"}, "arabic": {"title": "A"}}, "chapters": [{"id": 9, "bookId": 3, "arabic": "x", "english": "y"}],
        "hadiths": [{"id": 1, "idInBook": 1, "bookId": 3, "chapterId": 9, "arabic": "a", "english": {"narrator": "n", "text": "t"}}, {"id": 2, "idInBook": 2, "bookId": 3, "chapterId": 7, "arabic": "a", "english": {"narrator": "n", "text": "t"}}],
    }
    got = readers.read_book_file(spark, _write(tmp_path / "b.json", json.dumps(book)))
    assert rows(got["entries"].select("upstream_entry_id", "chapter_number", "has_chapter")) == sorted([(1, 1, True), (2, None, False)], key=repr)
    flat = [{"Book": "B", "Reference": "r/5", "In-book reference": "Book 1, Hadith 2", "English_Text": "Narrated Xyz: body", "Grade": "Hasan"}, {"Book": "B", "Reference": "r", "English_Text": "t"}]
    out = readers.read_flat_entries(spark, _write(tmp_path / "f.json", json.dumps(flat)))
    assert rows(out.select("number", "book_number", "english_narrator", "grade_label", "issue")) == sorted([(5, 1, "Xyz", "hasan", None), (None, None, None, "unknown", "no_number")], key=repr)


def test_catalogs_and_todo(spark, tmp_path):
    p = _write(tmp_path / "c.json", '{"version":"1","concepts":[{"slug":"a","surface_forms":["x"]},{"slug":"b"}]}')
    assert readers.read_catalog(spark, p, "concepts", "slug:string,surface_forms:array<string>").count() == 2
    p = _write(tmp_path / "t.json", '{"leaf_topics":{"a.b":{"family":"f"}}}')
    assert rows(readers.read_keyed_catalog(spark, p, "leaf_topics", "family:string")) == [("a.b", "f")]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert rows(readers.todo(a, b, "k")) == [(2,)] and readers.safe_table(spark, "no_such_table", "x int").count() == 0


def test_manifest_and_bundle(spark, tmp_path):
    _write(tmp_path / "b" / "v1" / "a.txt", "one")
    _write(tmp_path / "b" / "v1" / "b.txt", "two")
    sinks.write_manifest(spark, str(tmp_path / "b" / "v1"), str(tmp_path / "m.json"), "v1")
    _write(tmp_path / "b" / "v1" / "b.txt", "changed")
    (tmp_path / "b" / "v1" / "a.txt").unlink()
    assert rows(readers.check_manifest(spark, str(tmp_path / "b" / "v1"), str(tmp_path / "m.json"))) == [("a.txt", "missing"), ("b.txt", "changed")]
    with pytest.raises(FileNotFoundError):
        readers.read_bundle(str(tmp_path / "b"), "v1", ["a.txt"], require=True)
    assert readers.read_bundle(str(tmp_path / "b"), "v1", ["a.txt"], legacy="/old")["a.txt"] == "/old/a.txt"


def test_paged_source(spark):
    def page_of(chapter, page, per_page):
        found = [(chapter, f"{chapter}:{i}", "t") for i in range(5)][(page - 1) * per_page : page * per_page]
        return found, page + 1 if page * per_page < 5 else None

    class Pages(readers.PagedSource):
        fetch = staticmethod(page_of)

    spark.dataSource.register(Pages)
    df = spark.read.format("paged").option("chapters", "1,2").option("per_page", "2").load()
    assert df.count() == 10 and df.select(F.spark_partition_id()).distinct().count() == 2


def test_views_logs_and_reports(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x int").createOrReplaceTempView("t2")
    assert sinks.switch_view(spark, "alias_t", "t2", 2) and not sinks.switch_view(spark, "alias_t", "t2", 3) and spark.table("alias_t").count() == 2
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, t string")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_documents(df, str(tmp_path / "d.json"), "k")
    assert json.loads((tmp_path / "d.json").read_text()) == [{"k": 1, "t": "a"}, {"k": 2, "t": "b"}]
    sinks.write_report({"part": df}, str(tmp_path / "r.md"), "Title")
    assert "| 2 | b |" in (tmp_path / "r.md").read_text()


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    ev = spark.createDataFrame([(i, f"u{i % 3}", 1000 + 7 * i, f"p{i}") for i in range(30)], "id int, k string, s long, p string").select("id", "k", F.timestamp_seconds("s").alias("at"), "p")
    for i in range(3):
        ev.where(f"id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.1)
    stream = sessions.keep_latest(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(src)), "k", "at", "p", ttl_seconds=10_000)
    q = stream.writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT key, max_by(payload, n_seen) AS p FROM latest WHERE status = 'stored' GROUP BY key")
    want = latest_state(ev, "k", "at", "id", ["p"], F.timestamp_seconds(F.lit(2000)), 10_000).select("k", "p")
    assert rows(last) == rows(want)


def test_rewriting_keeps_the_old_files_until_the_new_ones_are_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame([(1, "a")], "k int, t string"), path, ["k"])
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("k"))
    with pytest.raises(Exception, match="no"):
        sinks.write_jsonl(broken, path)
    assert rows(readers.read_jsonl(spark, path, "k int, t string")) == [(1, "a")]
    sinks.write_jsonl(readers.read_jsonl(spark, path, "k int, t string").withColumn("k", F.col("k") + 1), path)
    assert rows(readers.read_jsonl(spark, f"file://{path}", "k int, t string")) == [(2, "a")]


def test_tables_are_recreated_and_views_switched(spark):
    sinks.recreate_table(spark, "quillon_index_a", "id long, t string")
    assert spark.table("quillon_index_a").count() == 0 and not sinks.switch_view(spark, "quillon_live", "quillon_index_a")
    spark.range(3).select("id", F.lit("x").alias("t")).write.insertInto("quillon_index_a")
    assert sinks.switch_view(spark, "quillon_live", "quillon_index_a", least=3) and not spark.catalog.getTable("quillon_live").isTemporary
    sinks.recreate_table(spark, "quillon_index_a", "id long, t string, n int", ["n"])
    assert spark.table("quillon_index_a").columns == ["id", "t", "n"]
    for kind, name in (("VIEW", "quillon_live"), ("TABLE", "quillon_index_a")):
        spark.sql(f"DROP {kind} {name}")


def test_batches_report_their_first_error(spark):
    def send(batch):
        if any(r["k"] == 7 for r in batch):
            raise ValueError("broken pipe")
        return ["odd" if r["k"] == 3 else None for r in batch]

    got = rows(sinks.send_batches(spark.range(10).select(F.col("id").alias("k")).coalesce(1), "k", send, size=5))
    assert got == sorted([(5, 1, "3", "odd"), (5, 5, "5", "broken pipe")], key=repr)
    assert sinks.send_batches(spark.range(0).select(F.col("id").alias("k")), "k", send).count() == 0
