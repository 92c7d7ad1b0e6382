import importlib
import sys

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_without_the_training_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("loomgraph.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loomgraph.llm", None)
    fresh = importlib.reload(entry)
    names = fresh.queries()
    assert "edge_agg" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
    assert set(fresh.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
