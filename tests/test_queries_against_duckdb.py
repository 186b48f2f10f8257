"""Every query with a SQL twin gives the twin's rows, and its types, on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans.catalog import registry
from weftline.sources.tables import TABLES

ROOT = "/root/testdata/sf0.001"
SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}

#: Queries that join with a single row (a total, or a constant that Spark folds into the join's condition).
ONE_ROW = {"j11_text_key_link", "j17_longest_prefix", "n8_classified_observations", "r10_unread_settings", "r6_lifecycle_inventory", "r7_vulnerable_versions"}


def plain(value):
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ROOT}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, duck, name):
    frame = registry.queries[name](spark, ROOT)
    plan = frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and ("NestedLoopJoin" not in plan or name in ONE_ROW)
    rows = frame.collect()
    if name not in registry.twins:
        assert len(frame.columns) == len(set(frame.columns))
        return
    twin = duck.sql(registry.twins[name])
    assert set(twin.columns) == set(frame.columns)
    types = dict(frame.dtypes)
    for column, kind in zip(twin.columns, twin.types, strict=True):
        if str(kind) in SPARK_TYPE:
            assert types[column] == SPARK_TYPE[str(kind)], column
    order = [frame.columns.index(c) for c in twin.columns]
    got = sorted((plain([r[i] for i in order]) for r in rows), key=repr)
    assert got == sorted((plain(r) for r in twin.fetchall()), key=repr)
