"""Order questions OQ0-OQ10.

Every function takes an ORDERS-shaped frame and returns a lazy frame.

Plan notes
----------
- Grouped questions: partial hash aggregate -> shuffle on the key -> final
  aggregate. All aggregates are algebraic, so a restaurant with a third of
  all orders is collapsed map-side before the shuffle.
- Shares of a total (OQ3, OQ5): the total is a scalar subquery over the
  already grouped rows, not a join; the subquery's aggregation exchange is
  the same plan as the main one, so Spark reuses it instead of scanning the
  orders again (``ReusedExchange`` in the plan). OQ10 sums its at most
  three grouped rows in a window instead (see there).
- Top-10 split (OQ9): one aggregation per restaurant computes every figure,
  then the 10 busiest restaurants are taken by a bounded top-k. No second
  scan and no semi join.
- Raw discount keys: groups are formed on the stored 1 / 0 / NULL value and
  labelled afterwards, so a NULL discount is its own group labelled like 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData

from tavola.functions.exact import exact_sum, pct2, r2, round2, share2_sql, sum2
from tavola.functions.sql import asc, count_all, desc, e, sql_string

# Limits and thresholds of the questions, and the labels.
TOP_REVENUE_LIMIT = 20            # OQ2
MOST_ORDERS_LIMIT = 20            # OQ6
TOP_AVG_VALUE_MIN_ORDERS = 10     # OQ8
TOP_AVG_VALUE_LIMIT = 20          # OQ8
SPLIT_TOP_RESTAURANTS = 10        # OQ9
MONTH_FORMAT = "yyyy-MM"          # OQ7
DISCOUNT_LABELS = ("Yes", "No")                   # OQ3, OQ4: code 1 / anything else
ORDER_TYPE_LABELS = ("Discounted", "Full Price")  # OQ10: code 1 / anything else


def _label_sql(labels: tuple[str, str]) -> str:
    return f"CASE WHEN discount_used = 1 THEN {sql_string(labels[0])} ELSE {sql_string(labels[1])} END"


def _by_restaurant(o: DataFrame) -> GroupedData:
    return o.groupBy(e("restaurant_name", "Restaurant"))


def oq1_payment_value(o: DataFrame) -> DataFrame:
    """OQ1: orders, revenue and average / min / max order value per payment method."""
    return (o.groupBy(e("payment_method", "Payment_Method"))
             .agg(count_all("Total_Orders"),
                  sum2("order_value", "Total_Revenue"),
                  r2("order_value", "Avg_Order_Value"),
                  round2("min(order_value)", "Min_Order_Value"),
                  round2("max(order_value)", "Max_Order_Value"))
             .orderBy(desc("Total_Revenue"), asc("Payment_Method")))


def oq2_top_revenue(o: DataFrame, limit: int = TOP_REVENUE_LIMIT) -> DataFrame:
    """OQ2: restaurants with the highest revenue."""
    return (_by_restaurant(o)
            .agg(count_all("Total_Orders"),
                 sum2("order_value", "Total_Revenue"),
                 r2("order_value", "Avg_Order_Value"))
            .orderBy(desc("Total_Revenue"), asc("Restaurant"))
            .limit(limit))


def oq3_discount_share(o: DataFrame) -> DataFrame:
    """OQ3: orders with and without a discount and their share of all orders."""
    g = o.groupBy("discount_used").agg(count_all("Total_Orders"))
    total = g.agg(e("sum(Total_Orders)")).scalar()
    return g.select(e(_label_sql(DISCOUNT_LABELS), "Discount_Used"), e("Total_Orders"),
                    pct2(e("Total_Orders"), total).alias("Percentage"))


def oq4_discount_value(o: DataFrame) -> DataFrame:
    """OQ4: orders, average value and revenue with and without a discount.

    Sorted by the label, descending (``Yes`` before ``No``), then the raw code.
    """
    return (o.groupBy("discount_used")
             .agg(count_all("Total_Orders"),
                  r2("order_value", "Avg_Order_Value"),
                  sum2("order_value", "Total_Revenue"))
             .orderBy(e(_label_sql(DISCOUNT_LABELS)).desc_nulls_last(), desc("discount_used"))
             .selectExpr(f"{_label_sql(DISCOUNT_LABELS)} AS Discount_Used", "Total_Orders",
                         "Avg_Order_Value", "Total_Revenue"))


def oq5_payment_share(o: DataFrame) -> DataFrame:
    """OQ5: orders per payment method and their share of all orders."""
    g = o.groupBy(e("payment_method", "Payment_Method")).agg(count_all("Total_Orders"))
    total = g.agg(e("sum(Total_Orders)")).scalar()
    return (g.select(e("Payment_Method"), e("Total_Orders"),
                     pct2(e("Total_Orders"), total).alias("Percentage"))
             .orderBy(desc("Total_Orders"), asc("Payment_Method")))


def oq6_most_orders(o: DataFrame, limit: int = MOST_ORDERS_LIMIT) -> DataFrame:
    """OQ6: restaurants with the most orders."""
    return (_by_restaurant(o)
            .agg(count_all("Total_Orders"), sum2("order_value", "Total_Revenue"))
            .orderBy(desc("Total_Orders"), asc("Restaurant"))
            .limit(limit))


def oq7_monthly_revenue(o: DataFrame) -> DataFrame:
    """OQ7: orders, revenue and average value per calendar month (months with orders only).

    Rows are grouped on the month-truncated timestamp (arithmetic per row);
    only the resulting months are formatted as text.
    """
    return (o.groupBy(e("date_trunc('MONTH', order_date)", "_month"))
             .agg(count_all("Total_Orders"),
                  sum2("order_value", "Total_Revenue"),
                  r2("order_value", "Avg_Order_Value"))
             .selectExpr(f"date_format(_month, '{MONTH_FORMAT}') AS Month", "Total_Orders",
                         "Total_Revenue", "Avg_Order_Value")
             .orderBy(asc("Month")))


def oq8_top_avg_value(o: DataFrame, min_orders: int = TOP_AVG_VALUE_MIN_ORDERS,
                      limit: int = TOP_AVG_VALUE_LIMIT) -> DataFrame:
    """OQ8: restaurants with the highest average order value among those with enough orders."""
    return (_by_restaurant(o)
            .agg(r2("order_value", "Avg_Order_Value"), count_all("Total_Orders"),
                 sum2("order_value", "Total_Revenue"))
            .where(f"Total_Orders >= {int(min_orders)}")
            .orderBy(desc("Avg_Order_Value"), asc("Restaurant"))
            .limit(limit))


def oq9_discount_split_top10(o: DataFrame, top: int = SPLIT_TOP_RESTAURANTS) -> DataFrame:
    """OQ9: revenue with / without discount for the ``top`` restaurants by order count.

    A NULL discount counts only in the totals. A NULL restaurant name can be
    among the busiest but never matches the selection, so it is dropped after
    the top-k, which is what an ``IN (subquery)`` does.
    """
    per_restaurant = (_by_restaurant(o)
                      .agg(count_all("_orders"),
                           sum2("CASE WHEN discount_used = 1 THEN order_value ELSE 0D END",
                                "Revenue_With_Discount"),
                           sum2("CASE WHEN discount_used = 0 THEN order_value ELSE 0D END",
                                "Revenue_Without_Discount"),
                           sum2("order_value", "Total_Revenue"),
                           e("sum(CASE WHEN discount_used = 1 THEN 1 ELSE 0 END)", "Discounted_Orders"),
                           e("sum(CASE WHEN discount_used = 0 THEN 1 ELSE 0 END)", "Full_Price_Orders")))
    busiest = (per_restaurant.orderBy(desc("_orders"), asc("Restaurant"))
                             .limit(top)
                             .where("Restaurant IS NOT NULL"))
    return (busiest.drop("_orders")
                   .orderBy(desc("Total_Revenue"), asc("Restaurant")))


def oq10_discount_impact(o: DataFrame) -> DataFrame:
    """OQ10: discounted vs full-price orders with their share of all revenue."""
    # The total is summed over the grouped rows in one window. Discount codes
    # are 1 / 0 / NULL, so the window holds at most three rows; a scalar
    # subquery here would prune to a different aggregate and scan the orders
    # a second time.
    return (o.groupBy("discount_used")
             .agg(count_all("Total_Orders"),
                  exact_sum("order_value", "_revenue"),
                  r2("order_value", "Avg_Order_Value"))
             .withColumn("_total", e("sum(_revenue) OVER ()"))
             .orderBy(desc("discount_used"))
             .selectExpr(f"{_label_sql(ORDER_TYPE_LABELS)} AS Order_Type", "Total_Orders",
                         "CAST(round(_revenue, 2) AS DOUBLE) AS Total_Revenue",
                         "Avg_Order_Value",
                         f"{share2_sql('_revenue', '_total')} AS Revenue_Percentage"))


def oq0_orders_overview(o: DataFrame) -> DataFrame:
    """OQ0: one row of totals over all orders (also over an empty table)."""
    return o.agg(count_all("Total_Orders"),
                 sum2("order_value", "Total_Revenue"),
                 r2("order_value", "Avg_Order_Value"),
                 e("count(DISTINCT restaurant_name)", "Unique_Restaurants"),
                 e("sum(discount_used)", "Discounted_Orders"))
