"""Twenty listing questions from one pass over the listings (batch mode).

One ``GROUPING SETS`` aggregation with five sets:

- the categorical cube ``(price_category, rating_category, online_order,
  book_table, cost bracket)``: at most a few hundred groups, from which
  D1, D4, Q3-Q6, Q10, Q13 and Q14 are re-aggregated;
- ``location``, with the premium-tier sums Q11 needs: D2, Q1, Q2, Q11,
  Q12, E2;
- ``cuisines``: Q7-Q9;
- ``rest_type``: E3; ``listed_type``: E4.

Every sum is kept as the BIGINT parts of ``tavola.functions.exact``, so
re-aggregating the cube is exact and every figure equals the single-question
plan's (tested). The row-level questions (D3, E1, E5, Q15) are not
aggregates and still run on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tavola.functions.exact import (
    avg_from_parts_sql,
    micros_sum_sql,
    whole_sum_sql,
)
from tavola.functions.sql import asc, desc, e, sql_string
from tavola.operators import listings as L
from tavola.plans.summary import materialise

CUBE = ("price_category", "rating_category", "online_order", "book_table", "bracket")
KEYS = CUBE + ("location", "cuisines", "rest_type", "listed_type")
SETS = {"cube": CUBE, "location": ("location",), "cuisines": ("cuisines",),
        "rest_type": ("rest_type",), "listed_type": ("listed_type",)}


def _gid(keys: tuple[str, ...]) -> int:
    # grouping_id(): one bit per key, first key most significant, set = rolled up
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)


GID = {name: _gid(keys) for name, keys in SETS.items()}


def listing_summary(r: DataFrame,
                    premium_categories: tuple[str, ...] = L.PREMIUM_PRICE_CATEGORIES) -> DataFrame:
    """Per grouping set: counts, exact rating / cost parts, premium-tier parts (Q11)."""
    premium = ", ".join(sql_string(c) for c in premium_categories)
    is_premium = f"price_category IN ({premium})"
    rated_cost = "CASE WHEN rate IS NOT NULL THEN approx_cost_for_two END"
    premium_rate = f"CASE WHEN {is_premium} THEN rate END"
    premium_cost = f"CASE WHEN rate IS NOT NULL AND {is_premium} THEN approx_cost_for_two END"
    bracket = (f"CASE WHEN approx_cost_for_two IS NULL THEN CAST(NULL AS STRING) "
               f"ELSE {L.cost_bracket_sql()} END AS bracket")
    base = r.selectExpr("price_category", "rating_category", "online_order", "book_table", bracket,
                        "location", "cuisines", "rest_type", "listed_type", "rate",
                        "approx_cost_for_two")
    return (base.groupingSets([list(k) for k in SETS.values()], *KEYS)
                .agg(e("grouping_id()", "gid"),
                     e("count(1)", "n"),
                     e("count(rate)", "n_rated"),
                     e(whole_sum_sql("rate"), "r_whole"), e(micros_sum_sql("rate"), "r_micros"),
                     e(whole_sum_sql(rated_cost), "c_whole"), e(micros_sum_sql(rated_cost), "c_micros"),
                     e(f"count({rated_cost})", "c_n"),
                     e(f"count_if(rate IS NOT NULL AND {is_premium})", "p_n"),
                     e(whole_sum_sql(premium_rate), "pr_whole"),
                     e(micros_sum_sql(premium_rate), "pr_micros"),
                     e(whole_sum_sql(premium_cost), "pc_whole"),
                     e(micros_sum_sql(premium_cost), "pc_micros"),
                     e(f"count({premium_cost})", "pc_n")))


def _round(whole: str, micros: str, count: str, places: int) -> str:
    return f"CAST(round({avg_from_parts_sql(whole, micros, count)}, {places}) AS DOUBLE)"


_RATING = _round("r_whole", "r_micros", "n_rated", 2)


class ListingAnswers:
    """Listing questions over one materialised summary."""

    def __init__(self, summary: DataFrame):
        self.summary = summary

    def _set(self, name: str) -> DataFrame:
        return self.summary.where(f"gid = {GID[name]}")

    def _cube_by(self, keys: dict[str, str], where: str | None = None) -> DataFrame:
        """Re-aggregate the categorical cube on ``keys`` (column -> output name)."""
        cube = self._set("cube")
        if where:
            cube = cube.where(where)
        return (cube.groupBy(*[e(f"`{k}`", a) for k, a in keys.items()])
                    .agg(e("sum(n)", "n"), e("sum(n_rated)", "n_rated"),
                         e("sum(r_whole)", "r_whole"), e("sum(r_micros)", "r_micros"),
                         e("sum(c_whole)", "c_whole"), e("sum(c_micros)", "c_micros"),
                         e("sum(c_n)", "c_n")))

    def _rating_by(self, keys: dict[str, str], where: str | None = None) -> DataFrame:
        out = self._cube_by(keys, where).where("n_rated > 0")
        return out.selectExpr(*keys.values(), f"{_RATING} AS Avg_Rating", "n_rated AS Num_Restaurants")

    # dashboard ----------------------------------------------------------------
    def d1_count_by_price(self) -> DataFrame:
        return (self._cube_by({"price_category": "Price_Category"})
                .selectExpr("Price_Category", "n AS Total_Restaurants")
                .orderBy(desc("Total_Restaurants"), asc("Price_Category")))

    def d2_high_rated_locations(self, min_avg: float = L.HIGH_RATED_LOCATION_MIN_AVG) -> DataFrame:
        raw = avg_from_parts_sql("r_whole", "r_micros", "n_rated")
        return (self._set("location")
                .where(f"n_rated > 0 AND {raw} > {float(min_avg)!r}BD")
                .selectExpr("location AS Location", f"{_RATING} AS Avg_Rating",
                            "n_rated AS Num_Restaurants")
                .orderBy(desc("Avg_Rating"), asc("Location")))

    def d4_rating_by_price(self) -> DataFrame:
        return (self._rating_by({"price_category": "Price_Category"})
                .orderBy(desc("Avg_Rating"), asc("Price_Category")))

    # explorer option lists --------------------------------------------------------
    def _options(self, col: str) -> DataFrame:
        return self._set(col).where(f"`{col}` IS NOT NULL").selectExpr(f"`{col}`").orderBy(asc(col))

    def e2_location_options(self) -> DataFrame:
        return self._options("location")

    def e3_rest_type_options(self) -> DataFrame:
        return self._options("rest_type")

    def e4_listed_type_options(self) -> DataFrame:
        return self._options("listed_type")

    # restaurant questions --------------------------------------------------------
    def _locations(self, rated: bool = True) -> DataFrame:
        loc = self._set("location").where("location IS NOT NULL")
        return loc.where("n_rated > 0") if rated else loc

    def q1_best_locations(self, limit: int = L.BEST_LOCATIONS_LIMIT) -> DataFrame:
        return (self._locations()
                .selectExpr("location AS Location", f"{_RATING} AS Avg_Rating",
                            "n_rated AS Num_Restaurants")
                .orderBy(desc("Avg_Rating"), asc("Location")).limit(limit))

    def q2_saturated_locations(self, limit: int = L.SATURATED_LOCATIONS_LIMIT) -> DataFrame:
        return (self._locations(rated=False)
                .selectExpr("location AS Location", "n AS Restaurant_Count", f"{_RATING} AS Avg_Rating")
                .orderBy(desc("Restaurant_Count"), asc("Location")).limit(limit))

    def q3_online_order_effect(self) -> DataFrame:
        return (self._rating_by({"online_order": "Online_Order"})
                .orderBy(desc("Avg_Rating"), asc("Online_Order")))

    def q4_table_booking_effect(self) -> DataFrame:
        return (self._rating_by({"book_table": "Table_Booking"})
                .orderBy(desc("Avg_Rating"), asc("Table_Booking")))

    def q5_price_satisfaction(self) -> DataFrame:
        return (self._rating_by({"price_category": "Price_Category"}, "price_category IS NOT NULL")
                .orderBy(desc("Avg_Rating"), asc("Price_Category")))

    def q6_price_by_segment(self) -> DataFrame:
        return (self._cube_by({"price_category": "Price_Category", "rating_category": "Rating_Category"},
                              "price_category IS NOT NULL AND rating_category IS NOT NULL")
                .selectExpr("Price_Category", "Rating_Category", "n AS Num_Restaurants",
                            f"{_RATING} AS Avg_Rating")
                .orderBy(asc("Price_Category"), desc("Avg_Rating"), asc("Rating_Category")))

    def _cuisines(self) -> DataFrame:
        return self._set("cuisines").where("cuisines IS NOT NULL")

    def q7_common_cuisines(self, limit: int = L.COMMON_CUISINES_LIMIT) -> DataFrame:
        return (self._cuisines().selectExpr("cuisines AS Cuisine", "n AS Num_Restaurants")
                .orderBy(desc("Num_Restaurants"), asc("Cuisine")).limit(limit))

    def q8_best_cuisines(self, min_count: int = L.BEST_CUISINES_MIN_COUNT,
                         limit: int = L.BEST_CUISINES_LIMIT) -> DataFrame:
        return (self._cuisines().where(f"n_rated >= {int(min_count)}")
                .selectExpr("cuisines AS Cuisine", f"{_RATING} AS Avg_Rating",
                            "n_rated AS Num_Restaurants")
                .orderBy(desc("Avg_Rating"), asc("Cuisine")).limit(limit))

    def q9_niche_cuisines(self, count_range: tuple[int, int] = L.NICHE_CUISINES_COUNT,
                          min_avg: float = L.NICHE_CUISINES_MIN_AVG,
                          limit: int = L.NICHE_CUISINES_LIMIT) -> DataFrame:
        lo, hi = count_range
        raw = avg_from_parts_sql("r_whole", "r_micros", "n_rated")
        return (self._cuisines()
                .where(f"n_rated BETWEEN {int(lo)} AND {int(hi)} AND {raw} >= {float(min_avg)!r}BD")
                .selectExpr("cuisines AS Cuisine", "n_rated AS Num_Restaurants",
                            f"{_RATING} AS Avg_Rating")
                .orderBy(desc("Avg_Rating"), asc("Cuisine")).limit(limit))

    def q10_cost_vs_rating(self) -> DataFrame:
        return (self._cube_by({"bracket": "Cost_Bracket"}, "bracket IS NOT NULL")
                .where("n_rated > 0")
                .selectExpr("Cost_Bracket", f"{_RATING} AS Avg_Rating",
                            f"{_round('c_whole', 'c_micros', 'c_n', 0)} AS Avg_Cost",
                            "n_rated AS Num_Restaurants")
                .orderBy(asc("Avg_Cost"), asc("Cost_Bracket")))

    def q11_premium_locations(self, min_avg: float = L.PREMIUM_MIN_AVG,
                              min_count: int = L.PREMIUM_MIN_COUNT,
                              limit: int = L.PREMIUM_LIMIT) -> DataFrame:
        return (self._set("location").where("p_n > 0")
                .selectExpr("location AS Location",
                            f"{_round('pr_whole', 'pr_micros', 'p_n', 2)} AS Avg_Rating",
                            f"{_round('pc_whole', 'pc_micros', 'pc_n', 0)} AS Avg_Cost",
                            "p_n AS Num_Restaurants")
                .where(f"Avg_Rating >= {float(min_avg)!r}D AND Num_Restaurants >= {int(min_count)}")
                .orderBy(desc("Avg_Rating"), desc("Avg_Cost"), asc("Location")).limit(limit))

    def q12_demand_low_rating(self, min_count: int = L.BUSY_MIN_COUNT,
                              max_avg: float = L.BUSY_MAX_AVG) -> DataFrame:
        return (self._set("location").where("n_rated > 0")
                .selectExpr("location AS Location", "n_rated AS Num_Restaurants",
                            f"{_RATING} AS Avg_Rating")
                .where(f"Num_Restaurants >= {int(min_count)} AND Avg_Rating < {float(max_avg)!r}D")
                .orderBy(desc("Num_Restaurants"), asc("Location")))

    def q13_feature_bundle(self) -> DataFrame:
        return (self._rating_by({"online_order": "Online_Order", "book_table": "Table_Booking"})
                .orderBy(desc("Avg_Rating"), asc("Online_Order"), asc("Table_Booking")))

    def q14_success_factors(self, min_count: int = L.SUCCESS_MIN_COUNT,
                            limit: int = L.SUCCESS_LIMIT) -> DataFrame:
        keys = {"price_category": "Price_Category", "online_order": "Online_Order",
                "book_table": "Table_Booking"}
        return (self._rating_by(keys, "price_category IS NOT NULL")
                .where(f"Num_Restaurants >= {int(min_count)}")
                .orderBy(desc("Avg_Rating"), asc("Price_Category"), asc("Online_Order"),
                         asc("Table_Booking")).limit(limit))

    NAMES = ("d1_count_by_price", "d2_high_rated_locations", "d4_rating_by_price",
             "e2_location_options", "e3_rest_type_options", "e4_listed_type_options",
             "q1_best_locations", "q2_saturated_locations", "q3_online_order_effect",
             "q4_table_booking_effect", "q5_price_satisfaction", "q6_price_by_segment",
             "q7_common_cuisines", "q8_best_cuisines", "q9_niche_cuisines", "q10_cost_vs_rating",
             "q11_premium_locations", "q12_demand_low_rating", "q13_feature_bundle",
             "q14_success_factors")

    def all(self) -> dict[str, DataFrame]:
        """Every summarised listing question, keyed like the registry."""
        return {name: getattr(self, name)() for name in self.NAMES}


def listing_answers(r: DataFrame, path: str | None = None,
                    premium_categories: tuple[str, ...] = L.PREMIUM_PRICE_CATEGORIES
                    ) -> ListingAnswers:
    """Summarise the listings once (materialised) and return the question set over it.

    Q11's premium tiers are fixed when the summary is built.
    """
    return ListingAnswers(materialise(listing_summary(r, premium_categories), path))
