"""Plan shape: pushdown, pruning, no cross joins, single scans, exchange reuse."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tavola.plans.registry import QUERIES as OWN
from tavola.operators import listings as L, orders as O
from tavola.sources import binding, ingest
from tests.conftest import SF_SMALL


def _plan(df, executed=False) -> str:
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_or_nested_loop_in_any_query(spark):
    for name, fn in entry_module.queries().items():
        if name not in OWN:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, f"{name} plans {bad}"


def test_split_top10_scans_orders_once(spark):
    plan = _plan(O.oq9_discount_split_top10(binding.orders(spark, SF_SMALL)))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


def test_discount_share_reuses_the_grouped_exchange(spark):
    df = O.oq3_discount_share(binding.orders(spark, SF_SMALL))
    plan = _plan(df, executed=True)
    assert "ReusedExchange" in plan


def test_top_per_price_uses_no_window(spark):
    plan = _plan(L.q15_top_per_price(binding.listings(spark, SF_SMALL)))
    assert "Window" not in plan


def test_stored_table_pushdown_and_pruning(spark, tmp_path):
    path = str(tmp_path / "restaurants")
    ingest.write_table(binding.listings(spark, SF_SMALL), path)
    stored = ingest.load_listings(spark, path)
    plan = _plan(L.q1_best_locations(stored))
    assert "PushedFilters: [IsNotNull(rate), IsNotNull(location)]" in plan
    assert "ReadSchema: struct<rate:double,location:string>" in plan
    plan = _plan(L.q11_premium_locations(stored))
    assert "In(price_category, [High,Very High])" in plan


def test_topk_is_take_ordered(spark):
    plan = _plan(L.q1_best_locations(binding.listings(spark, SF_SMALL)))
    assert "TakeOrderedAndProject" in plan


def test_dedup_checks_see_both_copies(spark):
    queries = entry_module.queries()
    for name in ("c3_drop_duplicates", "clean_listings"):
        plan = _plan(queries[name](spark, SF_SMALL))
        assert plan.count("FileScan") == 2, name


def test_q15_shuffles_only_its_answer(spark, tmp_path):
    """Over a stored table: no join, and one exchange of listings, above the filter, for the sort."""
    from tavola.operators.listings import q15_top_per_price

    rows = [(f"R{i}", f"L{i % 7}", (18 + i % 32) / 10, i, 100, ("Cheap", "Low", "High")[i % 3]) for i in range(600)]
    path = str(tmp_path / "t")
    schema = "name string, location string, rate double, votes int, approx_cost_for_two int, price_category string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    df = q15_top_per_price(spark.read.parquet(path))
    plan = _plan(df)
    assert "Join" not in plan
    main = plan.split("Subquery")[0] + plan.split("Subquery")[-1]
    assert {r["Rating"] for r in df.collect()} == {4.9}
    assert main.count("Exchange rangepartitioning") == 1


def test_q15_holds_a_bounded_number_of_categories(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_PRICE_CATEGORIES", 2)
    rows = [("A", "L", 4.0, 1, 100, c) for c in ("Cheap", "Low", "High")]
    df = spark.createDataFrame(rows, "name string, location string, rate double, votes int, approx_cost_for_two int, price_category string")
    with pytest.raises(Exception, match="more than 2 price categories"):
        L.q15_top_per_price(df).collect()
    assert L.q15_top_per_price(df.where("price_category <> 'Low'")).count() == 2
    assert L.q15_top_per_price(df.limit(0)).count() == 0
