"""Registered queries: key -> ``(spark, sf_dir) -> DataFrame``.

Each entry binds the provided test tables to the LISTINGS / ORDERS roles
(``tavola.sources.binding``) and runs one named question over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators import cleaning, explore, listings, orders
from tavola.sources import binding, ingest, schemas

Query = Callable[[SparkSession, str], DataFrame]


def _on_listings(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(binding.listings(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _on_orders(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(binding.orders(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# Explorer selection used by the registered E1 / E5 variant with filters set.
SELECTIVE_FILTER = explore.ListingFilter(
    rest_type="PROMO", online_order="Yes", price_category="High", min_rate=3.0, max_cost=1900)


# ---------------------------------------------------------------------------
# Cleaning and ingest steps, fed from the raw rendering of the test tables.
# ---------------------------------------------------------------------------

def _nullable_int(col: str) -> str:
    # An INT column that holds NULLs is shown as DOUBLE here and in the
    # oracle: engines and their pandas conversions disagree on how to type
    # nullable integers (float with NaN vs a masked integer), while a NULL
    # double is NaN everywhere. Values are unchanged.
    return f"CAST({col} AS DOUBLE) AS {col}"


def c1_parse_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 over every listing: ``"4.1/5"`` / ``"NEW"`` back to a rating."""
    return cleaning.parse_rating(binding.raw_listings(spark, sf_dir)).select("name", "rate")


def c2_parse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 over every listing: ``"1,200"`` back to a cost."""
    return cleaning.parse_cost(binding.raw_listings(spark, sf_dir)).selectExpr(
        "name", _nullable_int("approx_cost_for_two"))


def c3_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing loaded twice, de-duplicated back to one copy.

    The second copy comes from the raw text, parsed and categorised again,
    so it is a different plan with equal rows (a plain self-union would be
    removed by the optimizer before the de-duplication saw it).
    """
    r = binding.listings(spark, sf_dir)
    again = cleaning.add_rating_category(cleaning.add_price_category(
        cleaning.parse_cost(cleaning.parse_rating(binding.raw_listings(spark, sf_dir)))))
    again = ingest.to_listings_schema(ingest.normalise_columns(again))
    out = cleaning.drop_duplicates(r.unionByName(again))
    return out.withColumn("approx_cost_for_two", F.expr("CAST(approx_cost_for_two AS DOUBLE)"))


def c4_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: listings with both a rating and a cost."""
    return cleaning.drop_missing(binding.listings(spark, sf_dir)).select(
        "name", "rate", "approx_cost_for_two")


def c5_price_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price category of every listing from its cost."""
    r = binding.listings(spark, sf_dir).drop("price_category")
    return cleaning.add_price_category(r).selectExpr(
        "name", _nullable_int("approx_cost_for_two"), "price_category")


def c6_rating_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating category of every listing from its rating."""
    r = binding.listings(spark, sf_dir).drop("rating_category")
    return cleaning.add_rating_category(r).select("name", "rate", "rating_category")


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C6 + I2 end to end: raw listings (each row twice) to the stored table."""
    raw = binding.raw_listings(spark, sf_dir)
    return cleaning.clean_listings(raw.unionAll(raw))


def i4_encode_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 over every order: Yes / No / other text to 1 / 0 / NULL."""
    return ingest.encode_discount(binding.raw_orders(spark, sf_dir)).selectExpr(
        "order_id", _nullable_int("discount_used"))


def i3_parse_order_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3's date step over every order: ISO text back to a timestamp.

    The parsed value is shown as ``yyyy-MM-dd HH:mm:ss`` text so that the
    comparison does not depend on how each engine types timestamps.
    """
    parsed = ingest.order_date_sql("order_date")
    return binding.orders_date_text(spark, sf_dir).selectExpr(
        "order_id", f"date_format({parsed}, 'yyyy-MM-dd HH:mm:ss') AS order_date")


def i6_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count of both bound tables."""
    return ingest.load_report({"restaurants": binding.listings(spark, sf_dir),
                               "orders": binding.orders(spark, sf_dir)})


def e1_filter_listings_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with equality filters set."""
    return explore.e1_filter_listings(binding.listings(spark, sf_dir), SELECTIVE_FILTER)


def e5_filter_summary_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 over E1 with equality filters set."""
    return explore.e5_filter_summary(binding.listings(spark, sf_dir), SELECTIVE_FILTER)


QUERIES: dict[str, Query] = {
    # Dashboard
    "d1_count_by_price": _on_listings(listings.d1_count_by_price),
    "d2_high_rated_locations": _on_listings(listings.d2_high_rated_locations),
    "d3_top_rated": _on_listings(listings.d3_top_rated),
    "d4_rating_by_price": _on_listings(listings.d4_rating_by_price),
    # Explorer
    "e1_filter_listings": _on_listings(explore.e1_filter_listings),
    "e1_filter_listings_selective": e1_filter_listings_selective,
    "e2_location_options": _on_listings(explore.e2_location_options),
    "e3_rest_type_options": _on_listings(explore.e3_rest_type_options),
    "e4_listed_type_options": _on_listings(explore.e4_listed_type_options),
    "e5_filter_summary": _on_listings(explore.e5_filter_summary),
    "e5_filter_summary_selective": e5_filter_summary_selective,
    # Restaurant questions
    "q1_best_locations": _on_listings(listings.q1_best_locations),
    "q2_saturated_locations": _on_listings(listings.q2_saturated_locations),
    "q3_online_order_effect": _on_listings(listings.q3_online_order_effect),
    "q4_table_booking_effect": _on_listings(listings.q4_table_booking_effect),
    "q5_price_satisfaction": _on_listings(listings.q5_price_satisfaction),
    "q6_price_by_segment": _on_listings(listings.q6_price_by_segment),
    "q7_common_cuisines": _on_listings(listings.q7_common_cuisines),
    "q8_best_cuisines": _on_listings(listings.q8_best_cuisines),
    "q9_niche_cuisines": _on_listings(listings.q9_niche_cuisines),
    "q10_cost_vs_rating": _on_listings(listings.q10_cost_vs_rating),
    "q11_premium_locations": _on_listings(listings.q11_premium_locations),
    "q12_demand_low_rating": _on_listings(listings.q12_demand_low_rating),
    "q13_feature_bundle": _on_listings(listings.q13_feature_bundle),
    "q14_success_factors": _on_listings(listings.q14_success_factors),
    "q15_top_per_price": _on_listings(listings.q15_top_per_price),
    # Order questions
    "oq0_orders_overview": _on_orders(orders.oq0_orders_overview),
    "oq1_payment_value": _on_orders(orders.oq1_payment_value),
    "oq2_top_revenue": _on_orders(orders.oq2_top_revenue),
    "oq3_discount_share": _on_orders(orders.oq3_discount_share),
    "oq4_discount_value": _on_orders(orders.oq4_discount_value),
    "oq5_payment_share": _on_orders(orders.oq5_payment_share),
    "oq6_most_orders": _on_orders(orders.oq6_most_orders),
    "oq7_monthly_revenue": _on_orders(orders.oq7_monthly_revenue),
    "oq8_top_avg_value": _on_orders(orders.oq8_top_avg_value),
    "oq9_discount_split_top10": _on_orders(orders.oq9_discount_split_top10),
    "oq10_discount_impact": _on_orders(orders.oq10_discount_impact),
    # Cleaning and ingest steps
    "c1_parse_rating": c1_parse_rating,
    "c2_parse_cost": c2_parse_cost,
    "c3_drop_duplicates": c3_drop_duplicates,
    "c4_drop_missing": c4_drop_missing,
    "c5_price_category": c5_price_category,
    "c6_rating_category": c6_rating_category,
    "clean_listings": clean_listings,
    "i3_parse_order_date": i3_parse_order_date,
    "i4_encode_discount": i4_encode_discount,
    "i6_load_report": i6_load_report,
}


# ---------------------------------------------------------------------------
# The load, from files: the bound tables are written as a listings CSV and as
# JSON Lines and read back by the loaders.
# ---------------------------------------------------------------------------

#: Every so many-th listing and order of the load job's files cannot be stored.
BAD_LISTINGS, BAD_ORDERS = 50, 83
_LISTING_ROWS = [_nullable_int(c) if c == "approx_cost_for_two" else c for c in schemas.LISTINGS_COLUMNS]
_ORDER_ROWS = ["order_id", "restaurant_name", "date_format(order_date, 'yyyy-MM-dd HH:mm:ss') AS order_date", "order_value",
               _nullable_int("discount_used"), "payment_method"]


def i1_scan_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I2: every listing from a CSV."""
    return ingest.load_listings_csv(spark, binding.listings_file(spark, sf_dir), multi_line=False).selectExpr(*_LISTING_ROWS)


def i3_scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 + I4: every order from JSON Lines."""
    return ingest.load_orders_json(spark, binding.orders_file(spark, sf_dir)).selectExpr(*_ORDER_ROWS)


def i5_replace_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 + I7: a stored table after it was replaced by all listings."""
    path, rows = f"{binding.table_folder(spark)}/restaurants", binding.listings(spark, sf_dir)
    ingest.write_table(rows.where("online_order = 'Yes'"), path)
    ingest.write_table(rows, path)
    return ingest.load_listings(spark, path).selectExpr(*_LISTING_ROWS)


def i6_load_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the load job over files with rows that cannot be stored."""
    return ingest.run_load(spark, binding.listings_file(spark, sf_dir, BAD_LISTINGS), binding.orders_file(spark, sf_dir, BAD_ORDERS),
                           binding.table_folder(spark), multi_line=False, max_rejected=1 << 62)


def i7_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the load job stored it."""
    out = binding.table_folder(spark)
    ingest.run_load(spark, binding.listings_file(spark, sf_dir), binding.orders_file(spark, sf_dir), out, multi_line=False)
    return ingest.load_orders(spark, f"{out}/orders").selectExpr(*_ORDER_ROWS)


#: Queries that write files first; apart from the others, whose time is compared over rounds.
LOAD_QUERIES: dict[str, Query] = {q.__name__: q for q in (i1_scan_listings, i3_scan_orders, i5_replace_write, i6_load_job, i7_table_scan)}
