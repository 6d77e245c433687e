import __spark_entry__ as e


def test_contract(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_queries_need_nothing_else(monkeypatch):
    """Where the training-data subpackage can't be imported, the others stay."""
    import sys

    for name in [n for n in sys.modules if n.startswith("kilnworks.llm") or n in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert set(e.oracle_sql()) <= set(e.queries())
