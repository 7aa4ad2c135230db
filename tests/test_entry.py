"""The driver's entry points, with and without the parts that may be absent."""

import subprocess
import sys

import pytest
from conftest import ROOT

HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "pipeline" in e.queries(), any(q.startswith("op1_") for q in e.queries()))
"""


@pytest.mark.parametrize("hidden", [(), ("ahocorasick",), ("cladeframe.llm",), ("corpus_pipeline",)], ids=lambda x: "-".join(x) or "none")
def test_entry_without(hidden):
    from cladeframe import queries as core

    n, sql, pipeline, ops = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) >= len(core.queries()) == len(core.oracle_sql()) <= int(sql)
    if {"ahocorasick", "cladeframe.llm"} & set(hidden):
        assert (pipeline, ops, int(n)) == ("False", "False", len(core.queries()))
    if "corpus_pipeline" in hidden:
        assert pipeline == "False"
