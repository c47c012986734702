"""Every registered graph query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphloom import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in registry.oracle_sql():
        res = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_lines_of_no_known_order_are_left_out(spark, tmp_path):
    for name in ("supplier", "part"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    orders, line = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("orders", "lineitem"))
    few = line.limit(300).localCheckpoint()
    keys = sorted(r[0] for r in few.select("l_orderkey").distinct().collect())
    orders.filter(orders.o_orderkey.isin(keys[1:])).write.parquet(str(tmp_path / "orders.parquet"))
    few.unionByName(few.limit(1).selectExpr(*[f"cast(null as {few.schema[c].dataType.simpleString()}) as {c}" if c == "l_orderkey" else c for c in few.columns])).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    for name in ("supplier", "part", "orders", "lineitem"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.queries()["graph_merge_edges"](spark, str(tmp_path)).select("rel", "src_id", "dst_id").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"select rel, src_id, dst_id from ({registry.oracle_sql()['graph_merge_edges']})").fetchall()) and got
