import sys

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_pipeline_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    names = set(__spark_entry__.queries())
    assert "c6_session_index" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names
