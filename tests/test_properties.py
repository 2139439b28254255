"""Properties over the bound test tables, result order, and exact rounding."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from tavola.operators import explore, listings as L, orders as O
from tavola.sources import binding
from tests import frames
from tests.conftest import SF_ORACLE


def _orders(spark):
    return binding.orders(spark, SF_ORACLE)


def _listings(spark):
    return binding.listings(spark, SF_ORACLE)


def test_shares_add_up(spark):
    o = _orders(spark)
    total = O.oq0_orders_overview(o).collect()[0]["Total_Orders"]
    for q in (O.oq3_discount_share, O.oq5_payment_share):
        rows = q(o).collect()
        assert sum(r["Total_Orders"] for r in rows) == total
        assert abs(sum(r["Percentage"] for r in rows) - 100.0) < 0.05
    impact = O.oq10_discount_impact(o).collect()
    assert abs(sum(r["Revenue_Percentage"] for r in impact) - 100.0) < 0.05


def test_split_within_totals(spark):
    rows = O.oq9_discount_split_top10(_orders(spark)).collect()
    named = O.oq9_discount_split_top10(_orders(spark).where("restaurant_name IS NOT NULL")).collect()
    most = {r["Restaurant"]: r["Total_Orders"] for r in O.oq6_most_orders(_orders(spark)).collect()}
    # Orders without a name are one of the ten busiest groups: it takes a place and is dropped.
    assert None in most and len(rows) == 9 and len(named) == 10
    assert {r["Restaurant"] for r in rows} < {r["Restaurant"] for r in named}
    for r in rows:
        assert r["Revenue_With_Discount"] + r["Revenue_Without_Discount"] <= r["Total_Revenue"] + 1e-6
        assert r["Discounted_Orders"] + r["Full_Price_Orders"] <= most[r["Restaurant"]]
    assert [r["Total_Revenue"] for r in rows] == sorted((r["Total_Revenue"] for r in rows), reverse=True)


def test_top_per_price_rows_equal_category_max(spark):
    r = _listings(spark)
    best = {x["Price_Category"]: x["m"] for x in
            r.where("rate IS NOT NULL AND price_category IS NOT NULL")
             .groupBy("price_category").agg({"rate": "max"})
             .withColumnsRenamed({"price_category": "Price_Category", "max(rate)": "m"}).collect()}
    rows = L.q15_top_per_price(r).collect()
    assert rows and all(x["Rating"] == best[x["Price_Category"]] for x in rows)
    keys = [(x["Price_Category"], -x["Votes"], x["Restaurant"]) for x in rows]
    assert keys == sorted(keys)


def test_filter_tightens_and_summary_counts(spark):
    r = _listings(spark)
    counts = [explore.e1_filter_listings(r, explore.ListingFilter(min_rate=m)).count()
              for m in (3.0, 3.5, 4.0, 4.5)]
    assert counts == sorted(counts, reverse=True)
    flt = explore.ListingFilter(min_rate=3.5, max_cost=2000)
    summary = explore.e5_filter_summary(r, flt).collect()[0]
    assert summary["Total_Restaurants"] == explore.e1_filter_listings(r, flt).count()


def test_result_order(spark):
    r = _listings(spark)
    q1 = L.q1_best_locations(r).collect()
    keys = [(-x["Avg_Rating"], x["Location"]) for x in q1]
    assert keys == sorted(keys) and len(q1) == 15
    e1 = explore.e1_filter_listings(r).collect()
    keys = [(-x["Rating"], -x["Votes"], x["Restaurant"]) for x in e1]
    assert keys == sorted(keys)
    months = [x["Month"] for x in O.oq7_monthly_revenue(_orders(spark)).collect()]
    assert months[0] is None and months[1:] == sorted(months[1:])  # orders without a date come first
    opts = [x["location"] for x in explore.e2_location_options(r).collect()]
    assert opts == sorted(opts)


def _half_up(values, places):
    exact = sum(Decimal(str(v)) for v in values) / len(values)
    return float(exact.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=500_000), min_size=1, max_size=12))
def test_exact_average_matches_decimal_arithmetic(spark, cents):
    values = [c / 100 for c in cents]
    o = frames.orders(spark, [{"order_value": v} for v in values])
    row = O.oq0_orders_overview(o).collect()[0]
    assert row["Avg_Order_Value"] == _half_up(values, 2)
    assert row["Total_Revenue"] == float(sum(Decimal(str(v)) for v in values))


def test_catalogue_covers_every_named_question(spark):
    from tavola.plans.catalogue import CATALOGUE, answer

    assert len(CATALOGUE) == 35
    r, o = _listings(spark), _orders(spark)
    for qid in CATALOGUE:
        df = answer(qid, listings=r, orders=o)
        assert df.columns


def test_question_catalogue_frame(spark):
    from tavola.plans.catalogue import question_catalogue

    df = question_catalogue(spark)
    assert df.columns == ["id", "question", "business_value"]
    assert df.count() == 35


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(min_value=-10_000_000_000_000, max_value=10_000_000_000_000),
                          st.integers(min_value=0, max_value=6)),
                min_size=1, max_size=15))
def test_exact_sum_and_average_of_six_place_values(spark, draws):
    from tavola.functions.exact import r2, sum2

    values = [Decimal(units).scaleb(-places) for units, places in draws]
    values = [v for v in values if abs(v) <= Decimal(10_000_000)] or [Decimal("1.5")]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = df.agg(sum2("x", "s"), r2("x", "a")).collect()[0]
    total = sum(values)
    assert row["s"] == float(total.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
    assert row["a"] == float((total / len(values)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def test_exact_sum_overflow_raises(spark):
    import pytest

    from tavola.functions.exact import sum2

    df = spark.createDataFrame([(9.0e18,), (9.0e18,)], "x double")
    with pytest.raises(Exception, match="(?i)overflow"):
        df.agg(sum2("x", "s")).collect()


def test_sums_of_two_place_values_are_exact_under_the_stated_bound(spark):
    import random
    from decimal import Decimal
    rng = random.Random(11)
    for top in (10**6, 10**9, 4 * 10**9):
        cents = [rng.randrange(100 * top) for _ in range(20_000)]
        df = spark.createDataFrame([(c / 100,) for c in cents], "x double")
        whole = df.selectExpr("sum(CAST(x AS BIGINT)) AS w", "sum(CAST(rint((x - CAST(x AS BIGINT)) * 1000000D) AS BIGINT)) AS m").first()
        assert Decimal(whole["w"]) + Decimal(whole["m"]) / 1_000_000 == Decimal(sum(cents)) / 100, top
