"""Every query of the library's own operators against DuckDB, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

from lorekeep.plans.registry import oracle_sql, queries
from tests.oracle import connect, same

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLE])
def test_oracle(key, spark, sf_dir, con):
    same(QUERIES[key](spark, sf_dir), con, ORACLE[key])


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in ORACLE])
def test_rows(key, spark, sf_dir):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry_survives_without_llm(spark, sf_dir):
    """In a process that finds neither lorekeep.llm nor corpus_pipeline."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("lorekeep.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names) and len(names) > 200
assert set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
