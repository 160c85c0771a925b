import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    sql, queries = entry.oracle_sql(), entry.queries()
    assert set(sql) <= set(queries)
    for name in ("eq_text", "between_float32", "spatial_range", "spatial_knn", "price_clean_online", "scan_live", "insert_visible", "delete_missing", "compact_sorted", "catalog_restart", "stored_range", "scan_with_deleted", "export_sinks", "varchar_truncate", "infer_schema", "p4_found", "p4_reasons", "p4_clean", "p6_found"):
        df = queries[name](spark, DATA)
        cols = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        got = [tuple(r) for r in df.select(*cols).collect()]
        def key(rows): return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
        assert key(got) == key(want), name


def test_a_broken_import_inside_llm_is_not_hidden(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kw)

    if entry.llm is None:
        pytest.skip("no llm")
    for m in [m for m in sys.modules if m.startswith("tesela.llm")]:
        monkeypatch.delitem(sys.modules, m)
    import tesela

    monkeypatch.delattr(tesela, "llm", raising=False)
    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
