"""The question catalogue: id -> question, business value and the query.

Ids are the registry keys; the numbers are the questions' numbers in the
original application. ``answer(id, listings_df, orders_df)`` runs one
question on role-shaped frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tavola.operators import explore, listings as L, orders as O


@dataclass(frozen=True)
class Question:
    id: str
    table: str                      # "restaurants" or "orders"
    question: str
    business_value: str
    run: Callable[[DataFrame], DataFrame]


# Question titles of the catalogue. What each is good for is in our words.
_RESTAURANT_QUESTIONS = [
    ("q1_best_locations", L.q1_best_locations,
     "Which locations have the highest average restaurant ratings?",
     "Where a strong brand or a new partner fits best."),
    ("q2_saturated_locations", L.q2_saturated_locations,
     "Which locations are over-saturated with restaurants?",
     "Which areas are crowded, so that growth can go elsewhere."),
    ("q3_online_order_effect", L.q3_online_order_effect,
     "Does online ordering improve restaurant ratings?",
     "Whether guests rate places with online orders higher."),
    ("q4_table_booking_effect", L.q4_table_booking_effect,
     "Does table booking correlate with higher customer ratings?",
     "Whether reservations go with better ratings."),
    ("q5_price_satisfaction", L.q5_price_satisfaction,
     "What price category delivers the best customer satisfaction?",
     "The price tier that guests like most."),
    ("q6_price_by_segment", L.q6_price_by_segment,
     "How do different price categories perform on rating segments?",
     "How each tier spreads over rating bands."),
    ("q7_common_cuisines", L.q7_common_cuisines,
     "Which cuisines are most common?",
     "What is offered most often."),
    ("q8_best_cuisines", L.q8_best_cuisines,
     "Which cuisines receive the highest average ratings?",
     "Kitchens worth promoting for their quality."),
    ("q9_niche_cuisines", L.q9_niche_cuisines,
     "Which cuisines perform well despite having fewer restaurants?",
     "Rare kitchens that guests love."),
    ("q10_cost_vs_rating", L.q10_cost_vs_rating,
     "What is the relationship between restaurant cost and rating?",
     "Whether paying more goes with a better rating."),
    ("q11_premium_locations", L.q11_premium_locations,
     "Which locations are ideal for premium restaurant onboarding?",
     "Areas ready for expensive restaurants."),
    ("q12_demand_low_rating", L.q12_demand_low_rating,
     "Which locations show high demand but lower average ratings?",
     "Busy areas whose quality lags."),
    ("q13_feature_bundle", L.q13_feature_bundle,
     "Do restaurants with both online ordering and table booking perform better?",
     "Whether using both features pays together."),
    ("q14_success_factors", L.q14_success_factors,
     "What combination of factors maximises restaurant success?",
     "Which mix of tier and features rates best."),
    ("q15_top_per_price", L.q15_top_per_price,
     "Which restaurants are top performers within each price category?",
     "The models to learn from in every tier."),
]

_ORDER_QUESTIONS = [
    ("oq1_payment_value", O.oq1_payment_value,
     "Total and average order value by payment method",
     "What each way of paying brings in."),
    ("oq2_top_revenue", O.oq2_top_revenue,
     "Which restaurants generate the highest total revenue?",
     "The partners that earn most."),
    ("oq3_discount_share", O.oq3_discount_share,
     "How many orders used a discount vs full price?",
     "How common discounts are."),
    ("oq4_discount_value", O.oq4_discount_value,
     "Average order value: discount used vs not used",
     "Whether discounted baskets are smaller."),
    ("oq5_payment_share", O.oq5_payment_share,
     "Which payment method is most popular?",
     "How guests like to pay."),
    ("oq6_most_orders", O.oq6_most_orders,
     "Which restaurants have the highest number of orders?",
     "The busiest partners."),
    ("oq7_monthly_revenue", O.oq7_monthly_revenue,
     "Monthly revenue trend (total revenue per month)",
     "Growth and seasons."),
    ("oq8_top_avg_value", O.oq8_top_avg_value,
     "Which restaurants have the highest average order value?",
     "Partners with the largest baskets."),
    ("oq9_discount_split_top10", O.oq9_discount_split_top10,
     "Revenue split by discount usage for Top 10 restaurants",
     "How much the busiest partners lean on discounts."),
    ("oq10_discount_impact", O.oq10_discount_impact,
     "Overall discount impact on total revenue",
     "What share of the money comes with a discount."),
    ("oq0_orders_overview", O.oq0_orders_overview,
     "Orders dataset overview",
     "The orders at a glance."),
]

_DASHBOARD = [
    ("d1_count_by_price", L.d1_count_by_price, "Restaurants by Price Category", ""),
    ("d2_high_rated_locations", L.d2_high_rated_locations, "Average Rating by Location", ""),
    ("d3_top_rated", L.d3_top_rated, "Rating Segmentation", ""),
    ("d4_rating_by_price", L.d4_rating_by_price, "Average Rating by Price Category", ""),
    ("e1_filter_listings", explore.e1_filter_listings, "Filter and explore restaurants", ""),
    ("e2_location_options", explore.e2_location_options, "Location options", ""),
    ("e3_rest_type_options", explore.e3_rest_type_options, "Restaurant type options", ""),
    ("e4_listed_type_options", explore.e4_listed_type_options, "Listed-in options", ""),
    ("e5_filter_summary", explore.e5_filter_summary, "Filter summary", ""),
]

CATALOGUE: dict[str, Question] = {
    **{k: Question(k, "restaurants", q, bv, fn) for k, fn, q, bv in _DASHBOARD},
    **{k: Question(k, "restaurants", q, bv, fn) for k, fn, q, bv in _RESTAURANT_QUESTIONS},
    **{k: Question(k, "orders", q, bv, fn) for k, fn, q, bv in _ORDER_QUESTIONS},
}


def question_catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a small frame ``id, question, business_value`` (35 rows), by id."""
    rows = [(q.id, q.question, q.business_value) for q in CATALOGUE.values()]
    return (spark.createDataFrame(rows, "id STRING, question STRING, business_value STRING")
                 .orderBy("id"))


def answer(question_id: str, listings: DataFrame | None = None,
           orders: DataFrame | None = None) -> DataFrame:
    """Run one catalogued question on the role-shaped table it needs."""
    q = CATALOGUE[question_id]
    table = listings if q.table == "restaurants" else orders
    if table is None:
        raise ValueError(f"{question_id} needs the {q.table} table")
    return q.run(table)
