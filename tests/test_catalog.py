"""Every query of the catalog against its SQL, and the driver's contract."""

from __future__ import annotations

import subprocess
import sys

import pytest

from quarry.plans import catalog
from tests.compare import same
from tests.conftest import ROOT, SF


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(isinstance(s, str) for s in e.oracle_sql().values())


def test_entry_without_the_optional_parts():
    code = """
import sys
class Missing:
    def find_spec(self, name, *_):
        if name == "corpus_pipeline" or name.startswith("quarry.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
names = list(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
