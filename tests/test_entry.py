"""The driver contract, and the registered queries against SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["machine_id", "kind", "step"]
    assert df.count() == 5 * 72


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("gone", ["ahocorasick", "public_tokenizers", "gridpulse.llm"])
def test_library_queries_survive_a_missing_optional_package(gone):
    code = (
        f"import sys; sys.modules[{gone!r}] = None\n"
        "import __spark_entry__ as e; from checks.queries import QUERIES\n"
        "assert set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())\n"
        "assert set(e.queries()) == set(QUERIES)"
    )
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=home, check=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(DATA), DATA, name) is None
