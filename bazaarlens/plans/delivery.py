"""Delivery times and lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import period_label
from bazaarlens.functions.numbers import mean_in_order, percent, ratio, zero_if_null
from bazaarlens.model import Mart
from bazaarlens.operators.distribution import equal_width_histogram, share_of
from bazaarlens.operators.ranking import top_k
from bazaarlens.plans.revenue import mean_of
from bazaarlens.plans.star import totals

BINS = 40
MAX_DAYS = 60


def delivery_by_state(mart: Mart) -> DataFrame:
    """Mean delivery time per state, flagged where above the mean of the states."""
    states = (
        totals(mart, ["state"])
        .select("state", ratio(F.col("days_sum"), F.col("days_n")).alias("avg_delivery_days"))
        .dropna()
    )
    # One row per state in this window.
    mean = mean_in_order(F.collect_list(F.struct("state", F.col("avg_delivery_days").alias("value"))).over(Window.partitionBy()))
    return states.select(
        "state", "avg_delivery_days", (F.col("avg_delivery_days") > mean).alias("above_mean")
    ).orderBy(F.desc("avg_delivery_days"), "state")


def delivery_national_avg(mart: Mart) -> DataFrame:
    """Both reference lines: the mean of the state means, and the mean over all orders."""
    of_known_state = F.when(F.col("state").isNotNull(), ratio(F.col("days_sum"), F.col("days_n")))
    means = F.collect_list(F.struct("state", of_known_state.alias("value")))
    return totals(mart, ["state"], keep_null_groups=True).agg(
        ratio(F.sum("days_sum"), F.sum("days_n")).alias("mean_of_orders"),
        mean_in_order(means).alias("mean_of_state_means"),
    )


def ontime_vs_late(mart: Mart) -> DataFrame:
    """Orders that came on time and late, with their shares."""
    classes = totals(mart, ["is_late"]).select(
        "is_late",
        F.when(F.col("is_late") == 0, "On-Time").when(F.col("is_late") == 1, "Late").alias("label"),
        F.col("n_rows").alias("orders"),
    )
    return classes.withColumn("share_pct", share_of(F.col("orders"))).orderBy("is_late")


def monthly_late_rate(mart: Mart) -> DataFrame:
    return (
        totals(mart, ["year", "month"])
        .select(
            "year",
            "month",
            period_label(F.col("year"), F.col("month")).alias("period"),
            percent(F.col("late_sum"), F.col("late_n")).alias("late_rate_pct"),
        )
        .orderBy("year", "month")
    )


def monthly_late_rate_mean(mart: Mart) -> DataFrame:
    return mean_of(monthly_late_rate(mart), "late_rate_pct", "mean_monthly_late_rate_pct", "year", "month")


def _days_counted(mart: Mart) -> DataFrame:
    """Orders per delivery time in days; combines inside each task."""
    return totals(mart, ["delivery_days"]).select("delivery_days", F.col("n_rows").alias("orders"))


def _with_mean_days(counts: DataFrame) -> DataFrame:
    """Mean delivery time of all counted orders, beside each distinct number of days."""
    everywhere = Window.partitionBy()
    days = F.sum(F.col("delivery_days") * F.col("orders")).over(everywhere)
    return counts.withColumn("mean_days", ratio(days, F.sum("orders").over(everywhere)))


def delivery_histogram(mart: Mart) -> DataFrame:
    """Delivery times of 0 to 60 days in 40 bins, and the mean of these orders."""
    counts = _with_mean_days(_days_counted(mart).filter(F.col("delivery_days").between(0, MAX_DAYS)))
    return equal_width_histogram(counts, "delivery_days", "orders", BINS, ["mean_days"])


def delivery_histogram_lt60(mart: Mart) -> DataFrame:
    """Delivery times below 60 days, negative ones too, in 40 bins, and the mean of all orders."""
    counts = _with_mean_days(_days_counted(mart)).filter(F.col("delivery_days") < MAX_DAYS)
    return equal_width_histogram(counts, "delivery_days", "orders", BINS, ["mean_days"])


def freight_pct_by_category(mart: Mart, k: int = 15) -> DataFrame:
    """Freight in percent of price for the categories of the highest mean freight.

    ``mean_freight_pct`` is the unweighted mean over the listed categories.
    """
    means = (
        totals(mart, ["category_en"])
        .select(
            "category_en",
            ratio(zero_if_null(F.col("price_sum")), F.col("price_n")).alias("avg_price"),
            ratio(zero_if_null(F.col("freight_sum")), F.col("freight_n")).alias("avg_freight"),
        )
        .dropna()
    )
    listed = top_k(means, k, F.desc("avg_freight"), F.asc("category_en")).withColumn(
        "freight_pct", percent(F.col("avg_freight"), F.col("avg_price"))
    )
    percents = F.collect_list(F.struct("category_en", F.col("freight_pct").alias("value")))
    mean = mean_in_order(percents.over(Window.partitionBy()))
    return listed.withColumn("mean_freight_pct", mean).orderBy(F.desc("avg_freight"), "category_en")
