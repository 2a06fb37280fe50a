import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from __spark_entry__ import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    got = entry.queries()[name](spark, tiny).collect()
    db = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    norm = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(norm(r[c]) for c in names) for r in got) == want


def test_library_stands_without_the_training_data_operators():
    code = "import sys, pkgutil, importlib; sys.modules['leafmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import leafmill; [importlib.import_module(m.name) for m in pkgutil.walk_packages(leafmill.__path__, 'leafmill.', onerror=lambda n: None) if not m.name.startswith('leafmill.llm')]; import __spark_entry__ as e; assert 'op1_toxicity' not in e.queries() and 'doc_lines' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
