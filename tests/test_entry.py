"""The driver's entry survives operators that can't be imported."""

import builtins
import sys

import __spark_entry__


def test_queries_without_a_library_of_the_operators(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "xxhash" or name.startswith("kbloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}")
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith("kbloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    found = __spark_entry__.queries()
    assert "crawl_topk" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
