"""Revenue over time, by category, weekday, price class and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import MONTHS, WEEKDAYS, period_label, position_in
from bazaarlens.functions.numbers import mean_in_order, ratio, round2, zero_if_null
from bazaarlens.model import DELIVERED, PRICE_LABELS, Mart
from bazaarlens.operators.distribution import in_fixed_order, share_of
from bazaarlens.operators.ranking import top_k
from bazaarlens.plans.star import totals


def daily_revenue(mart: Mart, status: str | None = DELIVERED) -> DataFrame:
    """Orders, revenue and average order per day that has orders of the given status."""
    fact = mart.fact if status is None else mart.fact.filter(F.col("order_status") == status)
    per_day = fact.groupBy("date_key").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_payment").alias("revenue"),
        F.count("total_payment").alias("paid"),
    )
    return per_day.join(mart.dim_date, "date_key").select(
        F.col("full_date").alias("order_date"),
        "year",
        "month",
        "month_name",
        "day_of_week",
        "order_count",
        F.col("revenue").alias("daily_revenue"),
        round2(ratio(F.col("revenue"), F.col("paid"))).alias("avg_order_value"),
    )


def rolling_revenue(mart: Mart, status: str | None = DELIVERED) -> DataFrame:
    """Moving and running sums over the days that have orders, and the change to the day before.

    The frames count rows, not calendar days: a day without orders takes no place. The windows
    run on one row per day, so their single task holds as many rows as the calendar has days.
    """
    in_time = Window.orderBy("order_date")

    def trailing(first: int):
        return F.sum("daily_revenue").over(in_time.rowsBetween(first, 0)).cast("double")

    before = F.lag("daily_revenue").over(in_time)
    change = ratio((F.col("daily_revenue") - before).cast("double") * 100.0, before)
    return (
        daily_revenue(mart, status)
        .select(
            "order_date",
            "year",
            "month_name",
            "day_of_week",
            "order_count",
            F.col("daily_revenue").cast("double").alias("daily_revenue"),
            "avg_order_value",
            trailing(-29).alias("rolling_30d_revenue"),
            trailing(-6).alias("rolling_7d_revenue"),
            trailing(Window.unboundedPreceding).alias("cumulative_revenue"),
            round2(change).alias("dod_change_pct"),
        )
        .orderBy("order_date")
    )


def peak_rolling_revenue(mart: Mart) -> DataFrame:
    return rolling_revenue(mart).agg(F.max("rolling_30d_revenue").alias("peak_rolling_30d_revenue"))


def monthly_revenue(mart: Mart) -> DataFrame:
    by_month = totals(mart, ["year", "month", "month_name"])
    return by_month.select(
        "year",
        "month",
        "month_name",
        period_label(F.col("year"), F.col("month")).alias("period"),
        zero_if_null(F.col("payment_sum")).alias("revenue"),
    ).orderBy("year", "month")


def monthly_aov(mart: Mart) -> DataFrame:
    """Mean payment of the paid orders of each month."""
    return (
        totals(mart, ["year", "month"])
        .select(
            "year",
            "month",
            period_label(F.col("year"), F.col("month")).alias("period"),
            ratio(F.col("payment_sum"), F.col("payment_n")).alias("avg_order_value"),
        )
        .orderBy("year", "month")
    )


def mean_of(df: DataFrame, column: str, name: str, *order: str) -> DataFrame:
    """Unweighted mean of the few rows of a report, added up in the order of the columns ``order``."""
    values = F.collect_list(F.struct(*order, F.col(column).alias("value")))
    return df.agg(mean_in_order(values).alias(name))


def monthly_aov_mean(mart: Mart) -> DataFrame:
    """Reference line of :func:`monthly_aov`: every month counts the same."""
    return mean_of(monthly_aov(mart), "avg_order_value", "mean_monthly_aov", "year", "month")


def _ranked_revenue(mart: Mart, by: str, k: int) -> DataFrame:
    revenue = totals(mart, [by]).select(by, zero_if_null(F.col("payment_sum")).alias("revenue"))
    return top_k(revenue, k, F.desc("revenue"), F.asc(by))


def top_categories(mart: Mart, k: int = 10) -> DataFrame:
    return _ranked_revenue(mart, "category_en", k)


def top_states(mart: Mart, k: int = 10) -> DataFrame:
    """States by revenue; the first one is flagged."""
    place = F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("state")))
    return _ranked_revenue(mart, "state", k).select("state", "revenue", (place == 1).alias("is_leader"))


def leader_share(mart: Mart, k: int = 10) -> DataFrame:
    """Share of the first state in the sum of the first ``k``."""
    return (
        _ranked_revenue(mart, "state", k)
        .select("state", "revenue", share_of(F.col("revenue")).alias("share_of_top_pct"))
        .orderBy(F.desc("revenue"), "state")
        .limit(1)
    )


def revenue_by_dow(mart: Mart) -> DataFrame:
    revenue = totals(mart, ["day_of_week"]).select(
        "day_of_week", zero_if_null(F.col("payment_sum")).alias("revenue")
    )
    week = in_fixed_order(revenue, "day_of_week", WEEKDAYS)
    return week.withColumn("is_weekend", F.col("day_of_week").isin("Saturday", "Sunday"))


def revenue_by_price_bucket(mart: Mart) -> DataFrame:
    buckets = totals(mart, ["price_bucket"]).select(
        "price_bucket",
        zero_if_null(F.col("payment_sum")).alias("revenue"),
        F.col("payment_n").alias("order_count"),
    )
    return in_fixed_order(buckets, "price_bucket", PRICE_LABELS)


def revenue_heatmap(mart: Mart) -> DataFrame:
    """Month by weekday, all years together; months without sales are left out."""
    cells = totals(mart, ["month_name", "day_of_week"])
    return (
        cells.groupBy("month_name")
        .pivot("day_of_week", list(WEEKDAYS))
        .agg(F.sum("payment_sum"))
        .select(
            "month_name",
            position_in(F.col("month_name"), MONTHS).alias("month"),
            *[zero_if_null(F.col(day)).alias(day.lower()) for day in WEEKDAYS],
        )
        .orderBy("month")
    )
