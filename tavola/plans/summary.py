"""All order questions from one pass over the orders (batch / dashboard mode).

Answered one by one, the eleven order questions scan the orders eleven
times, and four of them shuffle the orders by restaurant. Here a single
``GROUPING SETS`` aggregation computes every figure they need per
restaurant, per payment method, per discount code, per month and in total:
one scan and one shuffle of partial aggregates. The summary is small (about
one row per restaurant) and is materialised once, as a reliable checkpoint
in the cluster's ``spark.checkpoint.dir`` or as a Parquet table. Each
question is then a cheap query over it.

Sums are kept as the same BIGINT parts the single-question plans use
(integer parts and millionths), so every figure is identical to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tavola.functions.exact import (
    avg_from_parts_sql,
    from_parts_sql,
    micros_sum_sql,
    pct2,
    round2_sql,
    share2,
    whole_sum_sql,
)
from tavola.functions.sql import asc, desc, e, sql_string
from tavola.operators import orders as O

KEYS = ("restaurant_name", "payment_method", "discount_used", "month")

# grouping_id() bits follow KEYS, first key most significant; a set bit
# means the key is rolled up in that grouping set.
GID = {"restaurant": 0b0111, "payment": 0b1011, "discount": 0b1101, "month": 0b1110, "all": 0b1111}

_WITH = "CASE WHEN discount_used = 1 THEN order_value ELSE 0D END"
_WITHOUT = "CASE WHEN discount_used = 0 THEN order_value ELSE 0D END"


def order_summary(o: DataFrame) -> DataFrame:
    """Per grouping set: counts, exact value parts, min / max, discount splits."""
    base = o.selectExpr("restaurant_name", "payment_method", "discount_used",
                        "date_trunc('MONTH', order_date) AS month", "order_value")
    sets = [[k] for k in KEYS] + [[]]
    return (base.groupingSets(sets, *KEYS)
                .agg(e("grouping_id()", "gid"),
                     e("count(1)", "n"),
                     e("count(order_value)", "n_value"),
                     e(whole_sum_sql("order_value"), "v_whole"),
                     e(micros_sum_sql("order_value"), "v_micros"),
                     e("min(order_value)", "v_min"),
                     e("max(order_value)", "v_max"),
                     e("sum(discount_used)", "discount_sum"),
                     e("count_if(discount_used = 1)", "n_with"),
                     e("count_if(discount_used = 0)", "n_without"),
                     e(whole_sum_sql(_WITH), "with_whole"),
                     e(micros_sum_sql(_WITH), "with_micros"),
                     e(whole_sum_sql(_WITHOUT), "without_whole"),
                     e(micros_sum_sql(_WITHOUT), "without_micros")))


def materialise(summary: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the summary's lineage.

    With ``path``: a Parquet table partitioned by grouping set, so each
    question reads only its own set (partition pruning on ``gid``); the
    cluster's shared ``spark.checkpoint.dir`` is a natural parent folder.
    Without: a reliable checkpoint in ``spark.checkpoint.dir``.
    """
    if path is None:
        if summary.sparkSession.sparkContext.getCheckpointDir() is None:
            raise ValueError("no spark.checkpoint.dir is set: pass a shared path for the summary")
        return summary.checkpoint(eager=True)
    summary.write.mode("overwrite").partitionBy("gid").parquet(path)
    return summary.sparkSession.read.schema(summary.schema).parquet(path)


def _money(prefix: str) -> str:
    return f"CAST(round({from_parts_sql(prefix + '_whole', prefix + '_micros')}, 2) AS DOUBLE)"


_REVENUE = _money("v")
_AVG = f"CAST(round({avg_from_parts_sql('v_whole', 'v_micros', 'n_value')}, 2) AS DOUBLE)"


def _label(labels: tuple[str, str]) -> str:
    return f"CASE WHEN discount_used = 1 THEN {sql_string(labels[0])} ELSE {sql_string(labels[1])} END"


class OrderAnswers:
    """The order questions over one materialised summary."""

    def __init__(self, summary: DataFrame):
        self.summary = summary

    def _set(self, name: str) -> DataFrame:
        return self.summary.where(f"gid = {GID[name]}")

    def _total(self, expr: str) -> Column:
        return self._set("all").selectExpr(expr).scalar()

    def oq0_orders_overview(self) -> DataFrame:
        s = self.summary
        tot = f"gid = {GID['all']}"
        return s.agg(
            e(f"coalesce(sum(CASE WHEN {tot} THEN n END), 0)", "Total_Orders"),
            e(f"CAST(round({from_parts_sql(f'sum(CASE WHEN {tot} THEN v_whole END)', f'sum(CASE WHEN {tot} THEN v_micros END)')}, 2) AS DOUBLE)",
              "Total_Revenue"),
            e(f"CAST(round({avg_from_parts_sql(f'sum(CASE WHEN {tot} THEN v_whole END)', f'sum(CASE WHEN {tot} THEN v_micros END)', f'sum(CASE WHEN {tot} THEN n_value END)')}, 2) AS DOUBLE)",
              "Avg_Order_Value"),
            e(f"count_if(gid = {GID['restaurant']} AND restaurant_name IS NOT NULL)",
              "Unique_Restaurants"),
            e(f"sum(CASE WHEN {tot} THEN discount_sum END)", "Discounted_Orders"))

    def oq1_payment_value(self) -> DataFrame:
        return (self._set("payment")
                .selectExpr("payment_method AS Payment_Method", "n AS Total_Orders",
                            f"{_REVENUE} AS Total_Revenue", f"{_AVG} AS Avg_Order_Value",
                            f"{round2_sql('v_min')} AS Min_Order_Value",
                            f"{round2_sql('v_max')} AS Max_Order_Value")
                .orderBy(desc("Total_Revenue"), asc("Payment_Method")))

    def _restaurants(self) -> DataFrame:
        return self._set("restaurant").selectExpr(
            "restaurant_name AS Restaurant", "n AS Total_Orders", f"{_REVENUE} AS Total_Revenue",
            f"{_AVG} AS Avg_Order_Value", f"{_money('with')} AS Revenue_With_Discount",
            f"{_money('without')} AS Revenue_Without_Discount",
            "n_with AS Discounted_Orders", "n_without AS Full_Price_Orders")

    def oq2_top_revenue(self, limit: int = O.TOP_REVENUE_LIMIT) -> DataFrame:
        return (self._restaurants()
                .select("Restaurant", "Total_Orders", "Total_Revenue", "Avg_Order_Value")
                .orderBy(desc("Total_Revenue"), asc("Restaurant")).limit(limit))

    def oq3_discount_share(self) -> DataFrame:
        return self._set("discount").select(
            e(_label(O.DISCOUNT_LABELS), "Discount_Used"), e("n", "Total_Orders"),
            pct2(e("n"), self._total("n")).alias("Percentage"))

    def oq4_discount_value(self) -> DataFrame:
        return (self._set("discount")
                .orderBy(e(_label(O.DISCOUNT_LABELS)).desc_nulls_last(), desc("discount_used"))
                .selectExpr(f"{_label(O.DISCOUNT_LABELS)} AS Discount_Used", "n AS Total_Orders",
                            f"{_AVG} AS Avg_Order_Value", f"{_REVENUE} AS Total_Revenue"))

    def oq5_payment_share(self) -> DataFrame:
        return (self._set("payment")
                .select(e("payment_method", "Payment_Method"), e("n", "Total_Orders"),
                        pct2(e("n"), self._total("n")).alias("Percentage"))
                .orderBy(desc("Total_Orders"), asc("Payment_Method")))

    def oq6_most_orders(self, limit: int = O.MOST_ORDERS_LIMIT) -> DataFrame:
        return (self._restaurants().select("Restaurant", "Total_Orders", "Total_Revenue")
                .orderBy(desc("Total_Orders"), asc("Restaurant")).limit(limit))

    def oq7_monthly_revenue(self) -> DataFrame:
        return (self._set("month")
                .selectExpr(f"date_format(month, '{O.MONTH_FORMAT}') AS Month", "n AS Total_Orders",
                            f"{_REVENUE} AS Total_Revenue",
                            f"{_AVG} AS Avg_Order_Value")
                .orderBy(asc("Month")))

    def oq8_top_avg_value(self, min_orders: int = O.TOP_AVG_VALUE_MIN_ORDERS,
                          limit: int = O.TOP_AVG_VALUE_LIMIT) -> DataFrame:
        return (self._restaurants()
                .where(f"Total_Orders >= {int(min_orders)}")
                .select("Restaurant", "Avg_Order_Value", "Total_Orders", "Total_Revenue")
                .orderBy(desc("Avg_Order_Value"), asc("Restaurant")).limit(limit))

    def oq9_discount_split_top10(self, top: int = O.SPLIT_TOP_RESTAURANTS) -> DataFrame:
        busiest = (self._restaurants()
                   .orderBy(desc("Total_Orders"), asc("Restaurant")).limit(top)
                   .where("Restaurant IS NOT NULL"))
        return (busiest.select("Restaurant", "Revenue_With_Discount", "Revenue_Without_Discount",
                               "Total_Revenue", "Discounted_Orders", "Full_Price_Orders")
                       .orderBy(desc("Total_Revenue"), asc("Restaurant")))

    def oq10_discount_impact(self) -> DataFrame:
        total = self._total(from_parts_sql("v_whole", "v_micros"))
        return (self._set("discount")
                .orderBy(desc("discount_used"))
                .select(e(_label(O.ORDER_TYPE_LABELS), "Order_Type"), e("n", "Total_Orders"),
                        e(_REVENUE, "Total_Revenue"), e(_AVG, "Avg_Order_Value"),
                        share2(e(from_parts_sql("v_whole", "v_micros")), total)
                        .alias("Revenue_Percentage")))

    def all(self) -> dict[str, DataFrame]:
        """Every order question, keyed like the registry."""
        names = ("oq0_orders_overview", "oq1_payment_value", "oq2_top_revenue",
                 "oq3_discount_share", "oq4_discount_value", "oq5_payment_share",
                 "oq6_most_orders", "oq7_monthly_revenue", "oq8_top_avg_value",
                 "oq9_discount_split_top10", "oq10_discount_impact")
        return {name: getattr(self, name)() for name in names}


def order_answers(o: DataFrame, path: str | None = None) -> OrderAnswers:
    """Summarise the orders once (materialised) and return the question set over it."""
    return OrderAnswers(materialise(order_summary(o), path))
