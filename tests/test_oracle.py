"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare
from tests.conftest import SF_ORACLE, SF_SMALL
from tavola.plans.registry import LOAD_QUERIES, QUERIES

OWN = QUERIES | LOAD_QUERIES

QUERIES = {name: fn for name, fn in entry_module.queries().items() if name in OWN}
ORACLE = entry_module.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(OWN) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck_oracle, name):
    ok, msg = compare(spark, name, QUERIES[name], ORACLE[name], SF_ORACLE, duck_oracle)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["Location", "Avg_Rating", "Num_Restaurants"]


def test_queries_run_on_smallest_scale(spark):
    for name, fn in QUERIES.items():
        df = fn(spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()


_DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_types_match_oracle(spark, duck_oracle, name):
    spark_types = {f.name: _DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in QUERIES[name](spark, SF_ORACLE).schema.fields}
    rel = duck_oracle.sql(ORACLE[name])
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
