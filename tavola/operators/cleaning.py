"""Cleaning jobs for raw restaurant listings.

Raw listings carry the rating as text such as ``"4.1/5"`` or ``"NEW"`` and
the cost as text such as ``"1,200"``; they hold exact duplicate rows and
rows without a rating or cost, and have no category columns. Each step here
is a column expression or a single relational operator, so the whole
cleaning pipeline is one narrow stage plus the one shuffle of the de-duplication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions.sql import finite_sql, sql_string, whole_number_sql

# Our cut points (the source publishes none). Price: a cost at or below the
# bound gets the label; above the last bound is "Very High". Rating: a rate
# below the bound gets the label; at or above the last bound is "Good".
DEFAULT_PRICE_CUTS: tuple[tuple[int, str], ...] = (
    (300, "Cheap"), (600, "Low"), (1000, "Moderate"), (2000, "High"))
DEFAULT_PRICE_TOP = "Very High"
DEFAULT_RATING_CUTS: tuple[tuple[float, str], ...] = ((3.0, "Low"), (4.0, "Average"))
DEFAULT_RATING_TOP = "Good"


def rating_from_text_sql(c: str) -> str:
    """``"4.1/5"`` -> 4.1, ``"4.1 /5"`` -> 4.1; ``"NEW"``, ``"-"``, ``"NaN/5"``, ``"inf/5"`` -> NULL."""
    return finite_sql(f"try_cast(trim(split(CAST({c} AS STRING), '/')[0]) AS DOUBLE)")


def cost_from_text_sql(c: str) -> str:
    """``"1,200"`` -> 1200, ``"800.0"`` -> 800, ``"800.7"`` -> 801 (rounded half up);
    text that is not a number -> NULL."""
    return whole_number_sql(f"trim(replace(CAST({c} AS STRING), ',', ''))")


def parse_rating(df: DataFrame, col: str = "rate") -> DataFrame:
    """Rating text to double, non-numeric to NULL."""
    return df.withColumn(col, F.expr(rating_from_text_sql(f"`{col}`")))


def parse_cost(df: DataFrame, col: str = "approx_cost_for_two") -> DataFrame:
    """Cost text with thousands separators to int."""
    return df.withColumn(col, F.expr(cost_from_text_sql(f"`{col}`")))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows.

    One hash aggregation over all columns; map-side partial aggregation
    collapses a heavily repeated row before the shuffle.
    """
    return df.dropDuplicates()


def drop_missing(df: DataFrame, subset: Sequence[str] = ("rate", "approx_cost_for_two")) -> DataFrame:
    """C4: drop rows where any of ``subset`` is NULL (or NaN); the null tests reach the scan."""
    types = dict(df.dtypes)
    tests = [f"`{c}` IS NOT NULL" for c in subset]
    tests += [f"NOT isnan(`{c}`)" for c in subset if types[c] in ("double", "float")]
    return df.where(" AND ".join(tests))


def price_category_sql(cost: str = "approx_cost_for_two",
                       cuts: Sequence[tuple[int, str]] = DEFAULT_PRICE_CUTS,
                       top: str = DEFAULT_PRICE_TOP) -> str:
    """SQL CASE for the price category of the expression ``cost``."""
    whens = " ".join(f"WHEN {cost} <= {int(b)} THEN {sql_string(label)}" for b, label in cuts)
    return f"CASE WHEN {cost} IS NULL THEN CAST(NULL AS STRING) {whens} ELSE {sql_string(top)} END"


def rating_category_sql(rate: str = "rate",
                        cuts: Sequence[tuple[float, str]] = DEFAULT_RATING_CUTS,
                        top: str = DEFAULT_RATING_TOP) -> str:
    """SQL CASE for the rating category of the expression ``rate``."""
    whens = " ".join(f"WHEN {rate} < {float(b)!r}D THEN {sql_string(label)}" for b, label in cuts)
    return f"CASE WHEN {rate} IS NULL THEN CAST(NULL AS STRING) {whens} ELSE {sql_string(top)} END"


def add_price_category(df: DataFrame, cuts: Sequence[tuple[int, str]] = DEFAULT_PRICE_CUTS,
                       top: str = DEFAULT_PRICE_TOP, col: str = "approx_cost_for_two") -> DataFrame:
    """Derive ``price_category`` from the cost; NULL cost gives NULL."""
    return df.withColumn("price_category", F.expr(price_category_sql(f"`{col}`", cuts, top)))


def add_rating_category(df: DataFrame, cuts: Sequence[tuple[float, str]] = DEFAULT_RATING_CUTS,
                        top: str = DEFAULT_RATING_TOP, col: str = "rate") -> DataFrame:
    """Derive ``rating_category`` from the rating; NULL rate gives NULL."""
    return df.withColumn("rating_category", F.expr(rating_category_sql(f"`{col}`", cuts, top)))


def clean_listings(raw: DataFrame,
                   price_cuts: Sequence[tuple[int, str]] = DEFAULT_PRICE_CUTS,
                   rating_cuts: Sequence[tuple[float, str]] = DEFAULT_RATING_CUTS) -> DataFrame:
    """The whole cleaning job, in the documented order.

    rating text -> cost text -> drop duplicates -> drop missing -> derive
    categories -> rename bracketed columns. Output has the LISTINGS schema.
    """
    from tavola.sources.ingest import normalise_columns, to_listings_schema

    df = parse_cost(parse_rating(raw))
    df = drop_missing(drop_duplicates(df))
    df = add_rating_category(add_price_category(df, price_cuts), rating_cuts)
    return to_listings_schema(normalise_columns(df))
