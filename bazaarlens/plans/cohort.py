"""Customer cohorts by month of first order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import months_between_starts
from bazaarlens.functions.numbers import percent, ratio, round2, sum_money
from bazaarlens.model import Mart


def _sales_days(mart: Mart) -> DataFrame:
    """Fact rows with their day; the calendar side has one row per day and is left to the planner, which checks its size."""
    days = mart.dim_date.select("date_key", "full_date")
    return mart.fact.filter(F.col("customer_key").isNotNull()).join(days, "date_key")


def customer_first_order(mart: Mart) -> DataFrame:
    first = F.min("full_date")
    return (
        _sales_days(mart)
        .groupBy("customer_key")
        .agg(first.alias("first_order_date"))
        .select(
            "customer_key",
            (F.year("first_order_date") * 100 + F.month("first_order_date")).alias("cohort_month_key"),
            "first_order_date",
            F.trunc("first_order_date", "MM").alias("cohort_month"),
        )
    )


def customer_month_orders(mart: Mart) -> DataFrame:
    """Orders and revenue per customer and month of activity."""
    return (
        _sales_days(mart)
        .groupBy("customer_key", F.trunc("full_date", "MM").alias("order_month"))
        .agg(F.count("order_id").alias("orders_that_month"), sum_money(F.col("total_payment")).alias("revenue_that_month"))
    )


def _cells(mart: Mart) -> DataFrame:
    """Cohort month by order month.

    One pass over the fact. The first month comes from a window per customer over its months of
    activity, of which the calendar allows only so many, however many orders a customer has.
    """
    life = Window.partitionBy("customer_key")
    active = customer_month_orders(mart).withColumn("cohort_month", F.min("order_month").over(life))
    return active.groupBy("cohort_month", "order_month").agg(
        F.count("*").alias("active_customers"),
        F.sum("orders_that_month").alias("total_orders"),
        F.sum("revenue_that_month").alias("cohort_revenue"),
    )


def cohort_size(mart: Mart) -> DataFrame:
    return customer_first_order(mart).groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))


def cohort_retention(mart: Mart) -> DataFrame:
    """Customers of each cohort who order again, month by month.

    Every customer is active in the month of the first order, so a cohort's size is its own first
    cell.
    """
    cohort = Window.partitionBy("cohort_month")
    own = F.when(F.col("order_month") == F.col("cohort_month"), F.col("active_customers"))
    size = F.col("cohort_size")
    return (
        _cells(mart)
        .withColumn("cohort_size", F.max(own).over(cohort))
        .select(
            "cohort_month",
            "cohort_size",
            "order_month",
            months_between_starts(F.col("cohort_month"), F.col("order_month")).alias("months_since_first"),
            "active_customers",
            round2(percent(F.col("active_customers"), size)).alias("retention_rate_pct"),
            "total_orders",
            "cohort_revenue",
        )
        .orderBy("cohort_month", "months_since_first")
    )


def avg_month1_retention(mart: Mart) -> DataFrame:
    """Mean retention one month after the first order; no row where no cohort reaches it."""
    rate = F.col("retention_rate_pct").cast("decimal(20,2)")
    return (
        cohort_retention(mart)
        .filter("months_since_first = 1")
        .agg(ratio(F.sum(rate), F.count(rate)).alias("avg_month1_retention_pct"))
        .dropna()
    )
