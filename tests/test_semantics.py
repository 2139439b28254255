
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tavola.operators import explore, listings as L, orders as O
from tavola.sources.ingest import order_date_sql
from tests import frames


# Exact rounding of averages that land on a tie -------------------------

def test_average_tie_rounds_half_up(spark):
    # 4.1 + 4.1 + 4.1 + 3.8 sums to 16.099999999999998 in doubles; the exact
    # average is 4.025, which rounds up.
    r = frames.listings(spark, [{"rate": v, "location": "A"} for v in (4.1, 4.1, 4.1, 3.8)])
    row = L.q1_best_locations(r).collect()[0]
    assert row["Avg_Rating"] == 4.03


def test_money_sums_and_averages_are_exact(spark):
    o = frames.orders(spark, [{"order_value": 0.1, "restaurant_name": "A"} for _ in range(10)]
                      + [{"order_value": 1.005, "restaurant_name": "B"}])
    got = {r["Restaurant"]: r for r in O.oq2_top_revenue(o).collect()}
    assert got["A"]["Total_Revenue"] == 1.0
    assert got["A"]["Avg_Order_Value"] == 0.1
    assert got["B"]["Avg_Order_Value"] == 1.01


def test_negative_values_round_away_from_zero(spark):
    o = frames.orders(spark, [{"order_value": -1.005}])
    row = O.oq0_orders_overview(o).collect()[0]
    assert row["Total_Revenue"] == -1.01
    assert row["Avg_Order_Value"] == -1.01


# HAVING on the raw average vs on the rounded alias ---------------------

def test_raw_and_rounded_having_differ(spark):
    rates = (3.99, 4.0, 4.0)
    rows = [{"rate": v, "cuisines": "Niche", "location": "Loc", "approx_cost_for_two": 1200}
            for v in rates]
    rows += [{"rate": 4.0, "cuisines": "Other", "location": "Loc", "approx_cost_for_two": 1200}
             for _ in range(2)]
    r = frames.listings(spark, rows)
    niche = [x["Cuisine"] for x in L.q9_niche_cuisines(r).collect()]
    assert "Niche" not in niche            # raw average 3.9967 < 4.0
    premium = L.q11_premium_locations(r).collect()
    assert [x["Location"] for x in premium] == ["Loc"]   # rounded 4.0 >= 4.0
    assert premium[0]["Avg_Rating"] == 4.0


def test_d2_strict_raw_average(spark):
    r = frames.listings(spark, [{"rate": 4.0, "location": "Exact"}, {"rate": 4.0, "location": "Exact"},
                                {"rate": 4.1, "location": "Above"}, {"rate": 4.0, "location": "Above"}])
    got = [x["Location"] for x in L.d2_high_rated_locations(r).collect()]
    assert got == ["Above"]


# Alias / column collision and the NULL discount -------------------------

def test_null_discount_is_its_own_no_group(spark):
    o = frames.orders(spark, [{"discount_used": d} for d in (1, 0, None, 1)])
    share = sorted((r["Discount_Used"], r["Total_Orders"], r["Percentage"])
                   for r in O.oq3_discount_share(o).collect())
    assert share == [("No", 1, 25.0), ("No", 1, 25.0), ("Yes", 2, 50.0)]
    value = [r["Discount_Used"] for r in O.oq4_discount_value(o).collect()]
    assert value == ["Yes", "No", "No"]
    impact = [r["Order_Type"] for r in O.oq10_discount_impact(o).collect()]
    assert impact == ["Discounted", "Full Price", "Full Price"]


def test_shares_sum_to_all_orders(spark):
    o = frames.orders(spark, [{"payment_method": p} for p in ("Card", "Card", "UPI")])
    rows = O.oq5_payment_share(o).collect()
    assert [(r["Payment_Method"], r["Total_Orders"], r["Percentage"]) for r in rows] == [
        ("Card", 2, 66.67), ("UPI", 1, 33.33)]


# Cost brackets --------------------------------------------------------

def test_cost_brackets(spark):
    costs = (300, 301, 700, 701, 1500, 1501)
    r = frames.listings(spark, [{"approx_cost_for_two": c, "rate": 3.0} for c in costs])
    got = {x["Cost_Bracket"]: x["Num_Restaurants"] for x in L.q10_cost_vs_rating(r).collect()}
    assert got == {"0 - 300": 1, "301 - 700": 2, "701 - 1500": 2, "1500+": 1}
    order = [x["Cost_Bracket"] for x in L.q10_cost_vs_rating(r).collect()]
    assert order == ["0 - 300", "301 - 700", "701 - 1500", "1500+"]


# Division by zero ------------------------------------------------------

def test_zero_revenue_share_is_null(spark):
    o = frames.orders(spark, [{"order_value": 0.0, "discount_used": d} for d in (1, 0)])
    assert all(r["Revenue_Percentage"] is None for r in O.oq10_discount_impact(o).collect())


def test_empty_orders(spark):
    o = frames.orders(spark, [{}]).limit(0)
    assert O.oq3_discount_share(o).collect() == []
    assert O.oq5_payment_share(o).collect() == []
    # The overview is always one row
    row = O.oq0_orders_overview(o).collect()
    assert [tuple(x) for x in row] == [(0, None, None, 0, None)]


# Order dates -----------------------------------------------------------

def test_order_date_parsing(spark):
    texts = ["2024-03-15", "2024-1-5", "05/01/2024", "", "2024-01-31T23:30:00-05:00",
             "2024-03-15 10:20:30", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r[0] for r in df.select(F.expr(order_date_sql("d"))).collect()]
    assert got == [dt.datetime(2024, 3, 15), None, None, None, dt.datetime(2024, 2, 1, 4, 30),
                   dt.datetime(2024, 3, 15, 10, 20, 30), None]


def test_month_buckets(spark):
    o = frames.orders(spark, [{"order_date": dt.datetime(2024, 1, 31, 23, 0)},
                              {"order_date": dt.datetime(2024, 2, 1)},
                              {"order_date": None}])
    got = [(r["Month"], r["Total_Orders"]) for r in O.oq7_monthly_revenue(o).collect()]
    assert got == [(None, 1), ("2024-01", 1), ("2024-02", 1)]


# Explorer values are literals ------------------------------------------

def test_filter_value_with_apostrophe(spark):
    r = frames.listings(spark, [{"location": "St. John's Road", "rate": 4.0},
                                {"location": "Other", "rate": 4.5}])
    flt = explore.ListingFilter(location="St. John's Road")
    rows = explore.e1_filter_listings(r, flt).collect()
    assert [x["Location"] for x in rows] == ["St. John's Road"]
    summary = explore.e5_filter_summary(r, flt).collect()
    assert summary[0]["Total_Restaurants"] == 1


def test_filter_bounds_and_empty_summary(spark):
    r = frames.listings(spark, [{"rate": 3.4}, {"rate": 3.5}, {"rate": None},
                                {"rate": 4.0, "approx_cost_for_two": None},
                                {"rate": 4.0, "approx_cost_for_two": 2001}])
    assert explore.e1_filter_listings(r).count() == 1
    none = explore.ListingFilter(online_order="No")
    assert explore.e5_filter_summary(r, none).collect() == []


# NULL groups, ties and top-k --------------------------------------------------

def test_null_groups_are_kept_where_unfiltered(spark):
    r = frames.listings(spark, [{"approx_cost_for_two": None, "rate": 4.5, "location": None},
                                {"approx_cost_for_two": 100, "rate": 4.5, "location": None}])
    d1 = {x["Price_Category"]: x["Total_Restaurants"] for x in L.d1_count_by_price(r).collect()}
    assert d1 == {None: 1, "Cheap": 1}
    d2 = [x["Location"] for x in L.d2_high_rated_locations(r).collect()]
    assert d2 == [None]
    assert L.q1_best_locations(r).collect() == []


def test_unrated_listings_count_in_q2(spark):
    r = frames.listings(spark, [{"location": "A", "rate": None}, {"location": "A", "rate": None}])
    row = L.q2_saturated_locations(r).collect()[0]
    assert (row["Restaurant_Count"], row["Avg_Rating"]) == (2, None)


def test_top_per_price_keeps_ties(spark):
    r = frames.listings(spark, [
        {"name": "a", "rate": 4.9, "approx_cost_for_two": 100, "votes": 5},
        {"name": "b", "rate": 4.9, "approx_cost_for_two": 200, "votes": 9},
        {"name": "c", "rate": 4.0, "approx_cost_for_two": 250, "votes": 99},
        {"name": "d", "rate": 3.0, "approx_cost_for_two": 5000, "votes": 1}])
    got = [(x["Price_Category"], x["Restaurant"]) for x in L.q15_top_per_price(r).collect()]
    assert got == [("Cheap", "b"), ("Cheap", "a"), ("Very High", "d")]


def test_split_drops_null_restaurant_among_busiest(spark):
    names = [None] * 5 + ["A"] * 3 + ["B"] * 2 + ["C"]
    o = frames.orders(spark, [{"restaurant_name": n, "discount_used": i % 2}
                              for i, n in enumerate(names)])
    got = O.oq9_discount_split_top10(o, top=2).collect()
    assert [x["Restaurant"] for x in got] == ["A"]
    a = got[0]
    assert a["Discounted_Orders"] + a["Full_Price_Orders"] == 3
    assert a["Revenue_With_Discount"] + a["Revenue_Without_Discount"] == a["Total_Revenue"]


def test_limit_tie_break_is_by_key(spark):
    r = frames.listings(spark, [{"location": loc, "rate": 4.0} for loc in "DCBA"])
    got = [x["Location"] for x in L.q1_best_locations(r, limit=2).collect()]
    assert got == ["A", "B"]


def test_case_sensitive_text(spark):
    r = frames.listings(spark, [{"online_order": "yes", "rate": 4.0}, {"online_order": "Yes", "rate": 3.0}])
    got = {x["Online_Order"] for x in L.q3_online_order_effect(r).collect()}
    assert got == {"yes", "Yes"}
    assert explore.e1_filter_listings(r, explore.ListingFilter(online_order="Yes", min_rate=1.8)).count() == 1


def test_exact_3_995_rounds_up_and_passes_rounded_having_only(spark):
    rows = [{"rate": v, "cuisines": "Edge", "location": "Edge", "approx_cost_for_two": 2500}
            for v in (3.99, 4.0)] * 3
    r = frames.listings(spark, rows)
    premium = L.q11_premium_locations(r).collect()
    assert [(x["Location"], x["Avg_Rating"]) for x in premium] == [("Edge", 4.0)]
    assert L.q9_niche_cuisines(r).collect() == []


def test_rounded_upper_bound_in_q12(spark):
    # averages 3.895 (rounds to 3.9, not below it) and 3.885 (rounds to 3.89)
    rows = [{"rate": v, "location": "AtBound"} for v in (3.89, 3.9)] * 10
    rows += [{"rate": v, "location": "Below"} for v in (3.88, 3.89)] * 10
    got = [(x["Location"], x["Avg_Rating"]) for x in L.q12_demand_low_rating(frames.listings(spark, rows)).collect()]
    assert got == [("Below", 3.89)]
