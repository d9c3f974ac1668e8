"""The entry points work without the training-data operators."""

import sys

import __spark_entry__ as E


def test_library_queries_stay_when_the_subpackage_cannot_be_imported(monkeypatch):
    whole = set(E.queries())
    monkeypatch.setitem(sys.modules, "periodlens.llm", None)  # an import fails
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = set(E.queries())
    assert len(alone) == 92 and alone <= whole and set(E.oracle_sql()) == alone
