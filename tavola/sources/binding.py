"""Bind the provided test tables to the LISTINGS and ORDERS roles.

The test data has no restaurant tables, so ``part`` plays the listings
and ``orders`` plays the orders, through a plain projection (no row is
dropped or added). NULLs are placed by a rule on the key so that the null
handling of every query is exercised. The same projection is written once
more as DuckDB SQL in ``tavola.plans.oracle``; the two must agree.

The tables are read with their known layout (no footer scan to infer a
schema) and projected with SQL expression strings, one JVM call per column.
Only this module knows the test tables; the queries take role-shaped frames.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators.cleaning import price_category_sql, rating_category_sql
from tavola.session import shared_dir
from tavola.sources.ingest import discount_code_sql

# Layouts of the two provided tables that are read.
PART_SCHEMA = ("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, "
               "p_size INT, p_retailprice DOUBLE")
ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
                 "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")

# The rules of the binding (see FIXTURES.md).
#   rate     = (18 + least(31, (brand number % 8) * 4 + key % 8)) / 10, NULL every 13th key
#   cost     = 40 + (key * 37) % 5961, NULL every 89th key
#   location = brand, NULL every 101st key; cuisines NULL every 103rd key,
#   type every 107th, listed type every 109th
#   order value NULL every 211th order, date every 223rd, restaurant every 227th
#   discount = text 'maybe' (unmapped) every 97th order, 'Yes' when key % 10 < 4
#   payment  = F -> Card, O -> Cash, P -> UPI
_LISTING_EXPRS = {
    "name": "concat(p_name, ' ', CAST(p_partkey AS STRING))",
    "online_order": "CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END",
    "book_table": "CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END",
    "rate": ("CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE "
             "(18 + least(31, (CAST(substring(p_brand, 7) AS INT) % 8) * 4 + p_partkey % 8))"
             " / 10.0D END"),
    "votes": "CAST((p_partkey * 31) % 1000 AS INT)",
    "location": "CASE WHEN p_partkey % 101 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END",
    "rest_type": "CASE WHEN p_partkey % 107 = 0 THEN CAST(NULL AS STRING) ELSE p_type END",
    "dish_liked": "CAST(NULL AS STRING)",
    "cuisines": ("CASE WHEN p_partkey % 103 = 0 THEN CAST(NULL AS STRING) "
                 "ELSE concat(p_name, ', ', p_type) END"),
    "approx_cost_for_two": ("CASE WHEN p_partkey % 89 = 0 THEN CAST(NULL AS INT) "
                            "ELSE CAST(40 + (p_partkey * 37) % 5961 AS INT) END"),
    "listed_type": "CASE WHEN p_partkey % 109 = 0 THEN CAST(NULL AS STRING) ELSE p_type END",
    "listed_city": "p_brand",
}

_RAW_ORDER_EXPRS = {
    "order_id": "o_orderkey",
    "restaurant_name": "CASE WHEN o_orderkey % 227 = 0 THEN CAST(NULL AS STRING) ELSE concat('R', CAST(o_custkey AS STRING)) END",
    "order_date": "CASE WHEN o_orderkey % 223 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE o_orderdate END",
    "order_value": "CASE WHEN o_orderkey % 211 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END",
    "discount_used": ("CASE WHEN o_orderkey % 97 = 0 THEN 'maybe' "
                      "WHEN o_orderkey % 10 < 4 THEN 'Yes' ELSE 'No' END"),
    "payment_method": ("CASE o_orderstatus WHEN 'F' THEN 'Card' WHEN 'O' THEN 'Cash' "
                       "WHEN 'P' THEN 'UPI' END"),
}


def _read(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _project(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in exprs.items()])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as LISTINGS: one listing per part, categories derived as C5/C6 do."""
    base = _LISTING_EXPRS["rate"]
    cost = _LISTING_EXPRS["approx_cost_for_two"]
    exprs = {**_LISTING_EXPRS,
             "rating_category": rating_category_sql(f"({base})"),
             "price_category": price_category_sql(f"({cost})")}
    return _project(_read(spark, sf_dir, "part", PART_SCHEMA), exprs)


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a raw listings file would read: text rating and cost,
    bracketed column names, no categories.

    Rating ``4.1`` -> ``"4.1/5"`` or ``"4.1 /5"`` (missing -> ``"NEW"``, ``"-"``,
    ``"NaN/5"`` or empty); cost ``1200`` -> ``"1,200"``, ``" 1200 "`` or
    ``"1200.0"`` (missing -> NULL, ``"on request"`` or empty).
    """
    exprs = dict(_LISTING_EXPRS)
    rate, cost = exprs.pop("rate"), exprs.pop("approx_cost_for_two")
    exprs["rate"] = (f"coalesce(concat(format_string('%.1f', {rate}), CASE WHEN p_partkey % 2 = 0 THEN ' /5' ELSE '/5' END),"
                     " elt(CAST(p_partkey % 4 + 1 AS INT), 'NEW', '-', 'NaN/5', ''))")
    exprs["approx_cost_for_two"] = (f"coalesce(CASE p_partkey % 3 WHEN 0 THEN concat(' ', CAST({cost} AS STRING), ' ')"
                                    f" WHEN 1 THEN concat(CAST({cost} AS STRING), '.0') ELSE format_number({cost}, 0) END,"
                                    " elt(CAST(p_partkey % 3 + 1 AS INT), NULL, 'on request', ''))")
    exprs["listed_in(type)"] = exprs.pop("listed_type")
    exprs["listed_in(city)"] = exprs.pop("listed_city")
    return _project(_read(spark, sf_dir, "part", PART_SCHEMA), exprs)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the orders file would read: discount as Yes / No / other text."""
    return _project(_read(spark, sf_dir, "orders", ORDERS_SCHEMA), _RAW_ORDER_EXPRS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as ORDERS (discount text encoded as I4 does)."""
    exprs = dict(_RAW_ORDER_EXPRS)
    exprs["discount_used"] = discount_code_sql(f"({exprs['discount_used']})")
    return _project(_read(spark, sf_dir, "orders", ORDERS_SCHEMA), exprs)


def orders_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders with the date rendered as text for the date-parsing step: ISO, with an offset in
    every fifth; a missing one as text that is no date, in four ways."""
    exprs = dict(_RAW_ORDER_EXPRS)
    date = exprs["order_date"]
    exprs["order_date"] = (f"coalesce(concat(date_format({date}, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN o_orderkey % 5 = 0 THEN '+00:00' ELSE '' END),"
                           " elt(CAST(o_orderkey % 4 + 1 AS INT), '05/01/2024', '', 'soon', '2023-02-31'))")
    return _project(_read(spark, sf_dir, "orders", ORDERS_SCHEMA), exprs)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def listings_file(spark: SparkSession, sf_dir: str, bad_every: int | None = None) -> str:
    """A folder of CSV files that holds the cleaned listings, quoted and with bracketed names; the cost
    of every ``bad_every``-th key is no number."""
    path, cost = _folder(spark, "listings-csv"), "CAST(approx_cost_for_two AS STRING)"
    if bad_every:
        cost = f"CASE WHEN CAST(split_part(name, ' ', -1) AS BIGINT) % {int(bad_every)} = 0 THEN 'on request' ELSE {cost} END"
    rows = listings(spark, sf_dir).withColumn("approx_cost_for_two", F.expr(cost))
    rows = rows.withColumnsRenamed({"listed_type": "listed_in(type)", "listed_city": "listed_in(city)"})
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option("quoteAll", True).csv(path)
    return path


def orders_file(spark: SparkSession, sf_dir: str, bad_every: int | None = None) -> str:
    """A folder of JSON Lines that holds the raw orders; the value of every ``bad_every``-th key is no number."""
    path, value = _folder(spark, "orders-json"), "CAST(order_value AS STRING)"
    if bad_every:
        value = f"CASE WHEN order_id % {int(bad_every)} = 0 THEN 'many' ELSE {value} END"
    rows = raw_orders(spark, sf_dir).withColumn("order_value", F.expr(value))
    rows.withColumn("order_date", F.expr("date_format(order_date, \"yyyy-MM-dd'T'HH:mm:ss\")")).write.json(path)
    return path


def table_folder(spark: SparkSession) -> str:
    """A new folder for stored tables."""
    return _folder(spark, "tables")
