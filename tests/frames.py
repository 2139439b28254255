"""Small hand-made LISTINGS / ORDERS frames for edge cases the test tables lack."""

from __future__ import annotations

import datetime as dt

from tavola.sources import schemas

_LISTING_DEFAULTS = {
    "name": "x", "online_order": "Yes", "book_table": "No", "rate": 4.0, "votes": 10,
    "location": "Area", "rest_type": "Cafe", "dish_liked": None, "cuisines": "Cafe",
    "approx_cost_for_two": 500, "listed_type": "Delivery", "listed_city": "City",
    "rating_category": None, "price_category": None,
}

_ORDER_DEFAULTS = {
    "order_id": 0, "restaurant_name": "R", "order_date": dt.datetime(2024, 1, 1),
    "order_value": 100.0, "discount_used": 0, "payment_method": "Card",
}


def listings(spark, rows):
    """LISTINGS frame; each row is a dict overriding the defaults. Categories are
    derived with the library's cuts unless given."""
    from tavola.operators.cleaning import add_price_category, add_rating_category

    data = []
    derive_price = all("price_category" not in r for r in rows)
    derive_rating = all("rating_category" not in r for r in rows)
    for i, r in enumerate(rows):
        row = {**_LISTING_DEFAULTS, "name": f"r{i}", **r}
        data.append(tuple(row[c] for c in schemas.LISTINGS_COLUMNS))
    df = spark.createDataFrame(data, schemas.LISTINGS)
    if derive_price:
        df = add_price_category(df)
    if derive_rating:
        df = add_rating_category(df)
    return df.select(*schemas.LISTINGS_COLUMNS)


def orders(spark, rows):
    data = []
    for i, r in enumerate(rows):
        row = {**_ORDER_DEFAULTS, "order_id": i, **r}
        data.append(tuple(row[c] for c in schemas.ORDERS_COLUMNS))
    return spark.createDataFrame(data, schemas.ORDERS)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]
