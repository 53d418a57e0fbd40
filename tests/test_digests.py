"""Digests of files."""

import hashlib
import json
from collections import Counter

from conftest import rows

from quillon.sources import readers, sinks


def _parquet(spark, root, name, n, files=1):
    spark.range(0, n, 1, files).write.parquet(f"{root}/{name}.parquet")


def test_every_file_is_digested_and_counted(spark, tmp_path):
    import __spark_entry__ as entry

    for name, n, files in (("nation", 3, 1), ("documents", 7, 2), ("lineitem", 5, 1)):
        _parquet(spark, tmp_path, name, n, files)
    got = [r.asDict() for r in entry.queries()["s27_file_digests"](spark, str(tmp_path)).collect()]
    files = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.parquet") if p.is_file()}
    assert {r["file"]: (r["n_bytes"], r["sha256"]) for r in got} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()} and len(got) == 4
    total = Counter()
    for r in got:
        total[r["file"].split("/")[0]] += r["row_count"]
    assert total == {"nation.parquet": 3, "documents.parquet": 7, "lineitem.parquet": 5}


def test_rows_by_kind_of_file(spark, tmp_path):
    texts = {"a.jsonl": b"{}\n{}", "b.csv": b"h\r\n1\r\n2\r\n", "c d%20é.csv": b"", "e.txt": b"h\r1\n", "f.bin": b"\n\n", "sub/a.jsonl": b"{}\n"}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert rows(readers.file_digests(spark, str(tmp_path)).select("file", "row_count")) == sorted([("a.jsonl", 2), ("b.csv", 2), ("c d%20é.csv", 0), ("e.txt", 1), ("f.bin", None), ("sub/a.jsonl", 1)], key=repr)
    assert readers._file_facts(str(tmp_path / "b.csv"), chunk=2) == (9, hashlib.sha256(texts["b.csv"]).hexdigest(), 2)


def test_manifest_holds_and_checks_row_counts(spark, tmp_path):
    _parquet(spark, tmp_path / "b", "t", 4)
    sinks.write_manifest(spark, str(tmp_path / "b"), str(tmp_path / "m.json"), "v1")
    manifest = json.loads((tmp_path / "m.json").read_text())
    assert [a["row_count"] for a in manifest["assets"]] == [4]
    assert [s for _, s in rows(readers.check_manifest(spark, str(tmp_path / "b"), str(tmp_path / "m.json")))] == ["ok"]
    manifest["assets"][0]["row_count"] = 5
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert [s for _, s in rows(readers.check_manifest(spark, str(tmp_path / "b"), str(tmp_path / "m.json")))] == ["changed"]
    part = next((tmp_path / "b").rglob("*.parquet/*.parquet"))
    part.write_bytes(part.read_bytes()[:20])
    assert [s for _, s in rows(readers.check_manifest(spark, str(tmp_path / "b"), str(tmp_path / "m.json")))] == ["changed"]
