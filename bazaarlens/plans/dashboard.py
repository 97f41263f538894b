"""Headline figures and the composition of the three dashboard pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.numbers import benchmark_side, late_status, percent, ratio, zero_if_null
from bazaarlens.model import Mart
from bazaarlens.operators.distribution import share_of
from bazaarlens.plans import customers, delivery, revenue, rfm
from bazaarlens.plans.cube import buyers_by_orders
from bazaarlens.plans.star import totals


def headline_kpis(mart: Mart) -> DataFrame:
    """One row of totals over all orders."""
    if mart.buyers is None:
        people = mart.fact.agg(F.countDistinct("customer_key")).scalar()
    else:
        people = buyers_by_orders(mart).agg(F.coalesce(F.sum("customers"), F.lit(0))).scalar()
    categories = totals(mart, ["category_en"]).agg(F.count("*")).scalar()
    return totals(mart).select(
        zero_if_null(F.col("payment_sum")).alias("total_revenue"),
        F.col("n_rows").alias("total_orders"),
        ratio(F.col("payment_sum"), F.col("payment_n")).alias("avg_order_value"),
        ratio(F.col("days_sum"), F.col("days_n")).alias("avg_delivery_days"),
        percent(F.col("late_sum"), F.col("late_n")).alias("late_order_rate_pct"),
        ratio(F.col("score_sum"), F.col("score_n")).alias("avg_review_score"),
        people.alias("unique_customers"),
        categories.alias("unique_categories"),
    )


def kpi_vs_benchmark(mart: Mart, benchmark: float = 7.9) -> DataFrame:
    """Late rate against a fixed benchmark, and its traffic light."""
    rate = percent(F.col("late_sum"), F.col("late_n"))
    return totals(mart).select(
        rate.alias("late_order_rate_pct"),
        benchmark_side(rate, benchmark).alias("vs_benchmark"),
        late_status(rate).alias("late_rate_status"),
    )


def share_of_total(mart: Mart, rfm_result: DataFrame) -> DataFrame:
    """The slices of all share charts: ``chart, label, value, share_pct``."""

    def slices(df: DataFrame, label: str, **charts: str) -> DataFrame:
        lines = [
            F.struct(
                F.lit(chart.replace("_", " ")).alias("chart"),
                F.col(label).alias("label"),
                F.col(value).cast("decimal(38,2)").alias("value"),
            )
            for chart, value in charts.items()
        ]
        return df.select(F.inline(F.array(*lines)))

    by_bucket = revenue.revenue_by_price_bucket(mart).filter(F.col("revenue").isNotNull())
    parts = [
        slices(by_bucket, "price_bucket", revenue_by_price_bucket="revenue"),
        slices(delivery.ontime_vs_late(mart), "label", orders_by_delivery="orders"),
        slices(customers.repeat_buyers(mart), "buyer_type", customers_by_buyer_type="customers"),
        slices(
            customers.payment_type_split(mart),
            "payment_type",
            orders_by_payment_type="orders",
            revenue_by_payment_type="revenue",
        ),
        slices(rfm.segment_distribution(rfm_result), "segment", customers_by_segment="customers"),
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("share_pct", share_of(F.col("value"), ["chart"]))
        .orderBy("chart", F.desc("value"), "label")
    )


Page = dict[str, Callable[[], DataFrame]]


def revenue_page(mart: Mart) -> Page:
    """Series of the revenue page; give a sliced mart to slice the page."""
    return {
        "kpis": lambda: headline_kpis(mart),
        "late_rate_vs_benchmark": lambda: kpi_vs_benchmark(mart),
        "monthly_revenue": lambda: revenue.monthly_revenue(mart),
        "top_categories": lambda: revenue.top_categories(mart),
        "revenue_by_price_bucket": lambda: revenue.revenue_by_price_bucket(mart),
        "revenue_by_dow": lambda: revenue.revenue_by_dow(mart),
        "monthly_aov": lambda: revenue.monthly_aov(mart),
    }


def delivery_page(mart: Mart) -> Page:
    return {
        "kpis": lambda: headline_kpis(mart),
        "late_rate_status": lambda: kpi_vs_benchmark(mart),
        "delivery_by_state": lambda: delivery.delivery_by_state(mart).orderBy("avg_delivery_days", "state"),
        "delivery_national_avg": lambda: delivery.delivery_national_avg(mart),
        "monthly_late_rate": lambda: delivery.monthly_late_rate(mart),
        "monthly_late_rate_mean": lambda: delivery.monthly_late_rate_mean(mart),
        "delivery_histogram": lambda: delivery.delivery_histogram(mart),
        "ontime_vs_late": lambda: delivery.ontime_vs_late(mart),
    }


def customer_page(mart: Mart, rfm_result: DataFrame, segments: tuple[str, ...] = ()) -> Page:
    """Series of the customer page: reviews and payments follow the sliced mart, the customer
    table follows the chosen segments only."""
    return {
        "kpis": lambda: rfm.customer_kpis(rfm_result),
        "segment_revenue": lambda: rfm.segment_revenue(rfm_result, segments),
        "segment_distribution": lambda: rfm.segment_distribution(rfm_result, segments),
        "review_distribution": lambda: customers.review_distribution(mart),
        "payment_type_split": lambda: customers.payment_type_split(mart),
        "top_customers": lambda: rfm.top_customers(rfm_result, 20, segments),
    }
