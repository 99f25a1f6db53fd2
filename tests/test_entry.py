from __future__ import annotations

import importlib
import sys


def test_the_rest_works_without_the_optional_files(monkeypatch):
    for name in list(sys.modules):
        if name in ("__spark_entry__", "corpus_pipeline") or name.startswith("umbrascan.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "umbrascan.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "report_risk" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_sql_belongs_to_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_all_documents(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["doc_id", "total_flags", "risk"]
