"""The driver's contract, and independence from the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quillstone"), tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", ["commit_weighted_aggregate", "timeline_monthly", "prepare_balanced", "repo_share_cap", "auc_by_source", "text_features_native"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    df = e.queries()[name](spark, SMALL)
    cursor = con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
