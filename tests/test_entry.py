import importlib.util

import __spark_entry__ as entry


def test_names_and_sql_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 30


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["system", "rule", "k", "n", "rate", "ci_lo", "ci_hi"]
    assert rows.count() > 0


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "rubric_rates" in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    root = entry.ROOT
    for path in (root / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text(), path
    assert importlib.util.find_spec("tessera.plans.registry")
