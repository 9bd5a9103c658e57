"""Every query with SQL gives DuckDB's rows; the entry module works without the llm subpackage."""

from __future__ import annotations

import subprocess
import sys

import pytest

from sparkloom.plans import queries

from .conftest import ROOT


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_entry_without_llm():
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('sparkloom.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_does_not_import_llm():
    for path in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sparkloom.llm" not in path.read_text(), path
