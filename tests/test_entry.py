import __spark_entry__ as entry


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 180 and set(sql) <= set(queries)
    llm = [q for q in queries if q == "pipeline" or q[:2] == "op" and q[2].isdigit()]
    assert len(queries) - len(sql) <= 20 + len(llm)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "rank_ic", "observations"] and df.count() > 0
