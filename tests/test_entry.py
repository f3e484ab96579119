"""Registered queries against their SQL, on the smallest tables; and the entry without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

sys.path.insert(0, str(ROOT))
from rillstone.plans import queries as core  # noqa: E402


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_against_sql(spark, name):
    frame = core.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = db.execute(core.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert got == want


def test_queries_have_functions_and_sql_is_theirs():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trending' in q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    # what is left still passes: all of it is collected, and some of it is run
    tests = [sys.executable, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider"]
    listed = subprocess.run([*tests, "--collect-only"], cwd=copy, check=True, capture_output=True, text=True).stdout
    assert "test_core.py" in listed and "llm" not in listed.replace("without_llm", "")
    subprocess.run([*tests, "-k", "test_band_counts or test_graded_drain_order"], cwd=copy, check=True)
