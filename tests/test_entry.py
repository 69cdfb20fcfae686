import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import oracles, queries

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(oracles.SQL) <= set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["features_d5", "robust_apply", "knn_blocked_w20", "regime_report", "mst_all", "hdbscan_labels", "cluster_report", "chart_rows", "csv_round_trip"])
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.partition('.')[0]} as select * from '{SF}/{t}'")
    sql = c.sql(oracles.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(sql.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).map(lambda v: str(v)[:10] if hasattr(v, "year") else float(v) if isinstance(v, (int, float)) else v).values.tolist()))
    assert key(got) == key(sql)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_trees_span_all_rows(spark):
    n = queries.rows4(spark, SF).count()
    edges = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    exact = edges("mst_all")
    assert len(exact) == n - 1 and edges("mst_rounds_all") == exact
    rough = queries.QUERIES["mst_substrate"](spark, SF).first()
    assert rough["edges"] == n - 1 and rough["weight"] >= sum(w for _, _, w in exact) - 1e-3
