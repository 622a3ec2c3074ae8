import __spark_entry__ as entry_


def test_entry_and_registry(spark):
    assert entry_.entry(spark).count() > 0
    queries, sql = entry_.queries(), entry_.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50 and len(sql) > 40
