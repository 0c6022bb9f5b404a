import importlib
import sys

import __spark_entry__ as entry


def test_queries_and_sql_belong_together():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and all(map(callable, q.values()))


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "id", "source", "title", "score"]


def test_core_works_without_the_corpus_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("millrace.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "millrace.llm", None)
    without = importlib.reload(entry)
    assert without.queries() and not any(n.startswith("p1_") for n in without.queries())
    monkeypatch.undo()
    importlib.reload(entry)
