"""Listing questions: dashboard D1-D4 and restaurant questions Q1-Q15.

Every function takes a LISTINGS-shaped frame and returns a lazy frame.

Plan shape: scan (pruned columns, pushed ``IS NOT NULL`` filters) -> partial
hash aggregate -> shuffle on the grouping keys -> final aggregate -> filter
-> top-k (``TakeOrderedAndProject``) or sort. Every aggregate is algebraic
(count / sum / max), so a key holding a large share of rows is collapsed
map-side before the shuffle and never lands whole in one task.

Ordering: each sort ends in the output key columns, so a LIMIT keeps a
well-defined set of rows when the primary sort value ties. NULL keys sort
first ascending, last descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.exact import exact_avg, r0, r2
from tavola.functions.sql import asc, count_all, desc, e, not_null, sql_string

# Thresholds and limits of the questions.
HIGH_RATED_LOCATION_MIN_AVG = 4          # D2, on the raw average, strict
TOP_RATED_LIMIT = 20                     # D3
BEST_LOCATIONS_LIMIT = 15                # Q1
SATURATED_LOCATIONS_LIMIT = 15           # Q2
COMMON_CUISINES_LIMIT = 20               # Q7
BEST_CUISINES_MIN_COUNT = 5              # Q8
BEST_CUISINES_LIMIT = 20                 # Q8
NICHE_CUISINES_COUNT = (2, 15)           # Q9, inclusive
NICHE_CUISINES_MIN_AVG = 4.0             # Q9, on the raw average
NICHE_CUISINES_LIMIT = 20                # Q9
# Q10: lowest (None: no lowest) and highest cost of a bracket, and its label; anything else has the last label.
COST_BRACKETS = ((None, 300, "0 - 300"), (301, 700, "301 - 700"), (701, 1500, "701 - 1500"))
COST_BRACKET_TOP = "1500+"
PREMIUM_PRICE_CATEGORIES = ("High", "Very High")   # Q11
PREMIUM_MIN_AVG = 4.0                    # Q11, on the rounded average
PREMIUM_MIN_COUNT = 5                    # Q11
PREMIUM_LIMIT = 15                       # Q11
BUSY_MIN_COUNT = 20                      # Q12
BUSY_MAX_AVG = 3.9                       # Q12, on the rounded average, strict
SUCCESS_MIN_COUNT = 10                   # Q14
SUCCESS_LIMIT = 20                       # Q14
#: Q15: price categories whose maxima fit a map that every task holds.
MAX_PRICE_CATEGORIES = 1000


def _key(col: str, alias: str) -> Column:
    return e(f"`{col}`", alias)


# --------------------------------------------------------------------------
# Dashboard
# --------------------------------------------------------------------------

def d1_count_by_price(r: DataFrame) -> DataFrame:
    """Restaurants per price category; the NULL category is a group too."""
    return (r.groupBy(_key("price_category", "Price_Category"))
             .agg(count_all("Total_Restaurants"))
             .orderBy(desc("Total_Restaurants"), asc("Price_Category")))


def d2_high_rated_locations(r: DataFrame, min_avg: float = HIGH_RATED_LOCATION_MIN_AVG) -> DataFrame:
    """Locations whose unrounded average rating is above ``min_avg``."""
    return (r.where(not_null("rate"))
             .groupBy(_key("location", "Location"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"),
                  exact_avg("rate", "_avg"))
             .where(f"_avg > {float(min_avg)!r}BD")
             .drop("_avg")
             .orderBy(desc("Avg_Rating"), asc("Location")))


def d3_top_rated(r: DataFrame, limit: int = TOP_RATED_LIMIT) -> DataFrame:
    """The ``limit`` highest rated listings with their rating segment."""
    return (r.where(not_null("rate"))
             .selectExpr("name AS Restaurant", "rate AS Rate", "rating_category AS Rating_Segment")
             .orderBy(desc("Rate"), asc("Restaurant"), asc("Rating_Segment"))
             .limit(limit))


def d4_rating_by_price(r: DataFrame) -> DataFrame:
    """Average rating per price category; the NULL category is kept."""
    return (r.where(not_null("rate"))
             .groupBy(_key("price_category", "Price_Category"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .orderBy(desc("Avg_Rating"), asc("Price_Category")))


# --------------------------------------------------------------------------
# Restaurant questions
# --------------------------------------------------------------------------

def q1_best_locations(r: DataFrame, limit: int = BEST_LOCATIONS_LIMIT) -> DataFrame:
    """Q1: locations with the highest average rating."""
    return (r.where(not_null("rate", "location"))
             .groupBy(_key("location", "Location"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .orderBy(desc("Avg_Rating"), asc("Location"))
             .limit(limit))


def q2_saturated_locations(r: DataFrame, limit: int = SATURATED_LOCATIONS_LIMIT) -> DataFrame:
    """Q2: locations with the most listings; unrated listings count, the average skips them."""
    return (r.where(not_null("location"))
             .groupBy(_key("location", "Location"))
             .agg(count_all("Restaurant_Count"), r2("rate", "Avg_Rating"))
             .orderBy(desc("Restaurant_Count"), asc("Location"))
             .limit(limit))


def _avg_by_one(r: DataFrame, key: str, alias: str, extra_not_null: tuple[str, ...] = ()) -> DataFrame:
    return (r.where(not_null("rate", *extra_not_null))
             .groupBy(_key(key, alias))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .orderBy(desc("Avg_Rating"), asc(alias)))


def q3_online_order_effect(r: DataFrame) -> DataFrame:
    """Q3: average rating with and without online ordering."""
    return _avg_by_one(r, "online_order", "Online_Order")


def q4_table_booking_effect(r: DataFrame) -> DataFrame:
    """Q4: average rating with and without table booking."""
    return _avg_by_one(r, "book_table", "Table_Booking")


def q5_price_satisfaction(r: DataFrame) -> DataFrame:
    """Q5: average rating per (non-NULL) price category."""
    return _avg_by_one(r, "price_category", "Price_Category", ("price_category",))


def q6_price_by_segment(r: DataFrame) -> DataFrame:
    """Q6: listings and average rating per (price category, rating category)."""
    return (r.where(not_null("price_category", "rating_category"))
             .groupBy(_key("price_category", "Price_Category"),
                      _key("rating_category", "Rating_Category"))
             .agg(count_all("Num_Restaurants"), r2("rate", "Avg_Rating"))
             .orderBy(asc("Price_Category"), desc("Avg_Rating"), asc("Rating_Category")))


def q7_common_cuisines(r: DataFrame, limit: int = COMMON_CUISINES_LIMIT) -> DataFrame:
    """Q7: the most frequent cuisine combinations (whole strings)."""
    return (r.where(not_null("cuisines"))
             .groupBy(_key("cuisines", "Cuisine"))
             .agg(count_all("Num_Restaurants"))
             .orderBy(desc("Num_Restaurants"), asc("Cuisine"))
             .limit(limit))


def q8_best_cuisines(r: DataFrame, min_count: int = BEST_CUISINES_MIN_COUNT,
                     limit: int = BEST_CUISINES_LIMIT) -> DataFrame:
    """Q8: best rated cuisine combinations with at least ``min_count`` listings."""
    return (r.where(not_null("rate", "cuisines"))
             .groupBy(_key("cuisines", "Cuisine"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .where(f"Num_Restaurants >= {int(min_count)}")
             .orderBy(desc("Avg_Rating"), asc("Cuisine"))
             .limit(limit))


def q9_niche_cuisines(r: DataFrame, count_range: tuple[int, int] = NICHE_CUISINES_COUNT,
                      min_avg: float = NICHE_CUISINES_MIN_AVG,
                      limit: int = NICHE_CUISINES_LIMIT) -> DataFrame:
    """Q9: rare cuisine combinations (count in range) rated ``min_avg`` or more (unrounded)."""
    lo, hi = count_range
    return (r.where(not_null("rate", "cuisines"))
             .groupBy(_key("cuisines", "Cuisine"))
             .agg(count_all("Num_Restaurants"), r2("rate", "Avg_Rating"),
                  exact_avg("rate", "_avg"))
             .where(f"Num_Restaurants BETWEEN {int(lo)} AND {int(hi)} "
                    f"AND _avg >= {float(min_avg)!r}BD")
             .drop("_avg")
             .orderBy(desc("Avg_Rating"), asc("Cuisine"))
             .limit(limit))


def cost_bracket_sql(cost: str = "approx_cost_for_two") -> str:
    """Q10's bracket of a cost. Fractional costs between brackets fall to the top label."""
    above = lambda low: "" if low is None else f"{cost} >= {low} AND "
    tests = " ".join(f"WHEN {above(low)}{cost} <= {high} THEN {sql_string(label)}" for low, high, label in COST_BRACKETS)
    return f"CASE {tests} ELSE {sql_string(COST_BRACKET_TOP)} END"


def q10_cost_vs_rating(r: DataFrame) -> DataFrame:
    """Q10: average rating and cost per cost bracket."""
    return (r.where(not_null("rate", "approx_cost_for_two"))
             .groupBy(e(cost_bracket_sql(), "Cost_Bracket"))
             .agg(r2("rate", "Avg_Rating"), r0("approx_cost_for_two", "Avg_Cost"),
                  count_all("Num_Restaurants"))
             .orderBy(asc("Avg_Cost"), asc("Cost_Bracket")))


def q11_premium_locations(r: DataFrame, categories: tuple[str, ...] = PREMIUM_PRICE_CATEGORIES,
                          min_avg: float = PREMIUM_MIN_AVG, min_count: int = PREMIUM_MIN_COUNT,
                          limit: int = PREMIUM_LIMIT) -> DataFrame:
    """Q11: locations for premium onboarding; HAVING on the rounded average."""
    premium = F.expr(not_null("rate")) & F.col("price_category").isin(*categories)
    return (r.where(premium)
             .groupBy(_key("location", "Location"))
             .agg(r2("rate", "Avg_Rating"), r0("approx_cost_for_two", "Avg_Cost"),
                  count_all("Num_Restaurants"))
             .where(f"Avg_Rating >= {float(min_avg)!r}D AND Num_Restaurants >= {int(min_count)}")
             .orderBy(desc("Avg_Rating"), desc("Avg_Cost"), asc("Location"))
             .limit(limit))


def q12_demand_low_rating(r: DataFrame, min_count: int = BUSY_MIN_COUNT,
                          max_avg: float = BUSY_MAX_AVG) -> DataFrame:
    """Q12: busy locations whose rounded average is below ``max_avg``."""
    return (r.where(not_null("rate"))
             .groupBy(_key("location", "Location"))
             .agg(count_all("Num_Restaurants"), r2("rate", "Avg_Rating"))
             .where(f"Num_Restaurants >= {int(min_count)} AND Avg_Rating < {float(max_avg)!r}D")
             .orderBy(desc("Num_Restaurants"), asc("Location")))


def q13_feature_bundle(r: DataFrame) -> DataFrame:
    """Q13: average rating per (online ordering, table booking)."""
    return (r.where(not_null("rate"))
             .groupBy(_key("online_order", "Online_Order"), _key("book_table", "Table_Booking"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .orderBy(desc("Avg_Rating"), asc("Online_Order"), asc("Table_Booking")))


def q14_success_factors(r: DataFrame, min_count: int = SUCCESS_MIN_COUNT,
                        limit: int = SUCCESS_LIMIT) -> DataFrame:
    """Q14: best (price category, online ordering, table booking) combinations."""
    return (r.where(not_null("rate", "price_category"))
             .groupBy(_key("price_category", "Price_Category"),
                      _key("online_order", "Online_Order"),
                      _key("book_table", "Table_Booking"))
             .agg(r2("rate", "Avg_Rating"), count_all("Num_Restaurants"))
             .where(f"Num_Restaurants >= {int(min_count)}")
             .orderBy(desc("Avg_Rating"), asc("Price_Category"), asc("Online_Order"),
                      asc("Table_Booking"))
             .limit(limit))


def q15_top_per_price(r: DataFrame) -> DataFrame:
    """Q15: every listing whose rating equals its price category's maximum (ties kept).

    The maxima are one small map (a row per category), taken as a scalar: every
    listing is held against its own category's entry where it is scanned, so
    there is no join, and only the answer is shuffled, for the sort. A
    ``rank()`` window instead would sort every listing inside a handful of
    partitions, one per category. Price categories are labels; more than
    ``MAX_PRICE_CATEGORIES`` of them are an error, so the map stays small.
    """
    base = r.where(not_null("rate", "price_category")).selectExpr(
        "price_category AS Price_Category", "name AS Restaurant", "location AS Location",
        "rate AS Rating", "votes AS Votes", "approx_cost_for_two AS Cost_for_Two")
    best = base.groupBy("Price_Category").agg(e("max(Rating)", "top"))
    tops = best.agg(F.expr(f"""if(count(1) <= {MAX_PRICE_CATEGORIES},
        map_from_entries(collect_list(struct(Price_Category, top))),
        raise_error('more than {MAX_PRICE_CATEGORIES} price categories'))""").alias("tops")).scalar()
    return (base.where(F.col("Rating") == tops[F.col("Price_Category")])
                .orderBy(asc("Price_Category"), desc("Votes"), asc("Restaurant"), asc("Location")))
