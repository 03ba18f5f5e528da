"""The driver contract with and without the training-data operators."""

import sys

import pytest

import __spark_entry__ as entry
from voicegrid.plans.catalog import QUERIES
from voicegrid.plans.oracle import ORACLES


@pytest.mark.parametrize("absent", [["voicegrid.llm", "corpus_pipeline"], ["voicegrid.llm"], ["corpus_pipeline"], ["zstandard"]])
def test_absent_operators(monkeypatch, absent):
    for name in [name for name in sys.modules if name.startswith("voicegrid.llm") or name == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in absent:
        monkeypatch.setitem(sys.modules, name, None)
    found, oracles = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(found) and set(ORACLES) <= set(oracles) and set(oracles) <= set(found)
    if absent != ["corpus_pipeline"]:
        assert set(found) == set(QUERIES)
    assert "pipeline" not in found
