"""Schemas of the two stored tables (the LISTINGS and ORDERS roles)."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per restaurant listing, after cleaning.
LISTINGS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("online_order", T.StringType()),        # Yes / No
    T.StructField("book_table", T.StringType()),          # Yes / No
    T.StructField("rate", T.DoubleType()),                # 1.8 .. 4.9, nullable
    T.StructField("votes", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("rest_type", T.StringType()),
    T.StructField("dish_liked", T.StringType()),
    T.StructField("cuisines", T.StringType()),            # one opaque combination
    T.StructField("approx_cost_for_two", T.IntegerType()),
    T.StructField("listed_type", T.StringType()),
    T.StructField("listed_city", T.StringType()),
    T.StructField("rating_category", T.StringType()),     # Low / Average / Good
    T.StructField("price_category", T.StringType()),      # Cheap .. Very High
])

# One row per order.
ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("restaurant_name", T.StringType()),
    T.StructField("order_date", T.TimestampNTZType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("discount_used", T.IntegerType()),      # 1 / 0 / NULL
    T.StructField("payment_method", T.StringType()),      # Card / Cash / UPI
])

# The orders file as it arrives: every field as text, so that no value is lost
# before it is checked, and what of a record could not be read.
CORRUPT = "_corrupt_record"
ORDERS_FILE = T.StructType([T.StructField(f.name, T.StringType()) for f in ORDERS.fields]
                           + [T.StructField(CORRUPT, T.StringType())])

LISTINGS_COLUMNS = [f.name for f in LISTINGS.fields]
ORDERS_COLUMNS = [f.name for f in ORDERS.fields]
