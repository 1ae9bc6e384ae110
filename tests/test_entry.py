import importlib


def test_entry_and_registry(spark):
    m = importlib.import_module("__spark_entry__")
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["r_name", "n_name", "revenue", "n_lines", "n_orders"]
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
