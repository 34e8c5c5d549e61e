"""Queries against their SQL on rows that the test tables do not have."""

import itertools

import duckdb

from tickgraph.plans import catalogue


def test_exp_ln_sqrt_pow_of_odd_rows(spark, tmp_path):
    odd = [None, 0.0, -0.0, 0.05, 1.0, -0.05, 1e-310, 800.0, float("nan"), float("inf"), float("-inf")]
    keys = [(k, 1, 1, 1) for k in range(len(odd) ** 3)]
    values = itertools.product([abs(v) if v is not None else v for v in odd], odd, odd)
    rows = [(*k, *v) for k, v in zip(keys, values, strict=True)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(str, map(tuple, catalogue.ops_exp_ln_sqrt_pow(spark, str(tmp_path)).collect())))
    lineitem = f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'"
    con = duckdb.connect()
    con.execute(lineitem)
    assert got == sorted(map(str, con.execute(catalogue.SQL["ops_exp_ln_sqrt_pow"]).fetchall()))
