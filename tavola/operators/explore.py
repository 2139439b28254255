"""Listing explorer: the parameterised filter (E1), its option lists
(E2-E4) and its summary figures (E5).

The filter is one Column predicate; every option value enters it as a
literal value, never as query text, so any value (including one with a
quote in it) is compared literally. The predicates reach the Parquet scan
as pushed filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.exact import r0, r2
from tavola.functions.sql import asc, count_all, desc

# The option meaning "no predicate", and the explorer defaults
# and ranges (minimum rating 1.8-4.9 step 0.1, maximum cost 40-6000 step 100).
ALL = "All"
DEFAULT_MIN_RATE = 3.5
DEFAULT_MAX_COST = 2000
RATE_RANGE = (1.8, 4.9)
COST_RANGE = (40, 6000)
YES_NO_OPTIONS = ("Yes", "No")

# Equality filters: option field -> listings column.
_EQUALITY = {
    "location": "location",
    "rest_type": "rest_type",
    "listed_type": "listed_type",
    "online_order": "online_order",
    "book_table": "book_table",
    "price_category": "price_category",
}


@dataclass(frozen=True)
class ListingFilter:
    """Explorer selection; ``"All"`` (or None) leaves a field unconstrained."""

    location: str | None = ALL
    rest_type: str | None = ALL
    listed_type: str | None = ALL
    online_order: str | None = ALL
    book_table: str | None = ALL
    price_category: str | None = ALL
    min_rate: float = DEFAULT_MIN_RATE
    max_cost: int = DEFAULT_MAX_COST

    def predicate(self) -> Column:
        """The conjunction: rated, rate >= min, cost <= max, plus each chosen equality.

        The bounds are numbers formatted by ``float`` / ``int``; option values
        are compared as ``F.lit`` values, never spliced into query text.
        """
        min_rate = float(self.min_rate)
        if not math.isfinite(min_rate):
            raise ValueError(f"min_rate must be a finite number, got {self.min_rate!r}")
        pred = F.expr(f"rate IS NOT NULL AND rate >= {min_rate!r}D "
                      f"AND approx_cost_for_two <= {int(self.max_cost)}")
        for f in fields(self):
            if f.name in _EQUALITY:
                value = getattr(self, f.name)
                if value is not None and value != ALL:
                    pred = pred & (F.col(_EQUALITY[f.name]) == F.lit(str(value)))
        return pred


def _filtered(r: DataFrame, flt: ListingFilter | None) -> DataFrame:
    return r.where((flt or ListingFilter()).predicate())


def e1_filter_listings(r: DataFrame, flt: ListingFilter | None = None) -> DataFrame:
    """Matching listings, best rated and most voted first; no row limit.

    The full sort range-partitions the result, so it stays distributed; a
    caller that shows a page applies its own limit.
    """
    return (_filtered(r, flt)
            .selectExpr("name AS Restaurant", "location AS Location", "rest_type AS Type",
                        "cuisines AS Cuisines", "rate AS Rating", "votes AS Votes",
                        "approx_cost_for_two AS Cost_for_Two", "price_category AS Price_Category",
                        "rating_category AS Rating_Category", "online_order AS Online_Order",
                        "book_table AS Table_Booking", "listed_type AS Listed_In")
            .orderBy(desc("Rating"), desc("Votes"), asc("Restaurant"), asc("Location")))


def _options(r: DataFrame, col: str) -> DataFrame:
    return r.where(f"`{col}` IS NOT NULL").selectExpr(f"`{col}`").distinct().orderBy(asc(col))


def e2_location_options(r: DataFrame) -> DataFrame:
    """Distinct non-NULL locations, sorted."""
    return _options(r, "location")


def e3_rest_type_options(r: DataFrame) -> DataFrame:
    """Distinct non-NULL listing types, sorted."""
    return _options(r, "rest_type")


def e4_listed_type_options(r: DataFrame) -> DataFrame:
    """Distinct non-NULL listed-in types, sorted."""
    return _options(r, "listed_type")


def e5_filter_summary(r: DataFrame, flt: ListingFilter | None = None) -> DataFrame:
    """E5: count and mean rating / cost / votes of E1's rows; no row when E1 is empty."""
    return (_filtered(r, flt)
            .agg(count_all("Total_Restaurants"),
                 r2("rate", "Avg_Rating"),
                 r0("approx_cost_for_two", "Avg_Cost_for_Two"),
                 r0("votes", "Avg_Votes"))
            .where("Total_Restaurants > 0"))
