"""Every catalogue query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import pytest

from nodetide.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if v[i] is None or v[i] != v[i] else v[i] for i in at) for v in values), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name not in catalogue.SQL:
        assert values
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, values) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("change", ["value", "missing"])
def test_equivalence_check_sees_every_edge(spark, monkeypatch, change):
    from pyspark.sql import functions as F

    unpack, last = catalogue.connectivity.unpack, (F.col("i") == 62) & (F.col("j") == 63)
    other = {"value": lambda e: e.withColumn("r", F.when(last, F.col("r") + 0.5).otherwise(F.col("r"))), "missing": lambda e: e.filter(~last)}[change]
    monkeypatch.setattr(catalogue.connectivity, "unpack", lambda *a: other(unpack(*a)))
    assert not any(r.same for r in catalogue.equivalence_check(spark, SF).collect())
