"""The driver contract, and that the core stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_sql_only_for_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_llm():
    code = "import sys; sys.modules['quillon.llm'] = None\nimport importlib, pkgutil, quillon\n" + (
        "for m in pkgutil.walk_packages(quillon.__path__, 'quillon.'):\n    if not m.name.startswith('quillon.llm'):\n        importlib.import_module(m.name)\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_flagship_query(spark):
    import __spark_entry__ as entry

    assert "score" in entry.entry(spark).columns and entry.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p27_missing_verses", "a06_hierarchy", "k10_outcomes", "z02_latest_state", "j02_overlapping_sections", "w12_filled_sections", "p3_found"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x
    a = sorted((tuple(number(r[c]) for c in cols) for r in got.collect()), key=repr)
    order = [list(want.columns).index(c) for c in cols]
    b = sorted((tuple(number(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b
