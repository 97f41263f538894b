"""The ten business measures, evaluated per group of any attributes or per calendar grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.numbers import late_status, ratio, safe_divide, zero_if_null
from bazaarlens.model import Mart
from bazaarlens.plans.star import totals

# Calendar grains and the attributes that name one of their periods.
GRAINS = {"day": ["full_date"], "month": ["year", "month"], "quarter": ["year", "quarter"], "year": ["year"]}


def _late_rate() -> Column:
    return safe_divide(F.col("late_sum"), F.col("n_rows")) * 100.0


def measure_totals(mart: Mart, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, orders, order value over all orders, late rate, delivery days, review score."""
    return totals(mart, by, keep_null_groups=True).select(
        *by,
        F.col("payment_sum").alias("total_revenue"),
        F.col("n_rows").alias("total_orders"),
        safe_divide(F.col("payment_sum"), F.col("n_rows")).alias("avg_order_value"),
        _late_rate().alias("late_order_rate_pct"),
        ratio(F.col("days_sum"), F.col("days_n")).alias("avg_delivery_days"),
        ratio(F.col("score_sum"), F.col("score_n")).alias("avg_review_score"),
    )


def late_rate_status(mart: Mart, by: Sequence[str] = ()) -> DataFrame:
    return totals(mart, by, keep_null_groups=True).select(
        *by,
        _late_rate().alias("late_order_rate_pct"),
        late_status(_late_rate()).alias("late_rate_status"),
    )


def _by_day(mart: Mart, by: Sequence[str] = ()) -> DataFrame:
    """Every calendar day with its revenue, null without sales: as many rows as days.

    With attributes, one row per day and group that has revenue, with the attributes of the day.
    """
    if not by:
        revenue = totals(mart, ["date_key"]).select("date_key", F.col("payment_sum").alias("revenue"))
        return mart.dim_date.join(revenue, "date_key", "left")
    daily = totals(mart, [*by, "date_key"], keep_null_groups=True).filter("payment_sum IS NOT NULL")
    return daily.select(*by, "date_key", F.col("payment_sum").alias("revenue")).join(mart.dim_date, "date_key")


def revenue_yoy(mart: Mart, grain: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Revenue against the same days a year before, in percent; 0 where there is no earlier revenue.

    Single days are moved forward by a year and kept only where the calendar has them, before they
    are summed: a period that has only begun is compared with the same part of its predecessor.
    29 February counts with 28 February of the next year. With attributes, a group has a row for
    each period in which it has revenue or earlier revenue.
    """
    period = GRAINS[grain]
    keys = [*by, *period]
    days = _by_day(mart, by)
    calendar = mart.dim_date.select("full_date", *[c for c in period if c != "full_date"])
    earlier = days.select(*by, F.add_months("full_date", 12).alias("full_date"), "revenue").join(calendar, "full_date")
    none = F.lit(None).cast(days.schema["revenue"].dataType)
    # Both sides are added up together: no join of groups, whose attributes may be null.
    both = days.select(*keys, "revenue", none.alias("prior_revenue")).unionByName(
        earlier.select(*keys, none.alias("revenue"), F.col("revenue").alias("prior_revenue"))
    )
    growth = zero_if_null(F.col("revenue")) - F.col("prior_revenue")
    return (
        both.groupBy(*keys)
        .agg(F.sum("revenue").alias("revenue"), F.sum("prior_revenue").alias("prior_revenue"))
        .select(
            *keys,
            "revenue",
            "prior_revenue",
            (safe_divide(growth, F.col("prior_revenue")) * 100.0).alias("revenue_yoy_pct"),
        )
        .orderBy(*keys)
    )


def _last_of_period(days: DataFrame, grain: str, value: str) -> DataFrame:
    """The value on the last day of each period."""
    period = GRAINS[grain]
    if grain == "day":
        return days.select("full_date", value).orderBy("full_date")
    return (
        days.groupBy(*period)
        .agg(F.max("full_date").alias("last_date"), F.max_by(value, "full_date").alias(value))
        .orderBy(*period)
    )


#: The Spark name of a grain's unit, and the step from one period to the next.
_STEPS = {"day": ("day", "1 day"), "month": ("month", "1 month"), "quarter": ("quarter", "3 months"), "year": ("year", "1 year")}


def _counted_until(mart: Mart, by: Sequence[str], stop: Column, grain: str, value: str) -> DataFrame:
    """Per group and period, the revenue of the days that still count on its last day; a day counts until before ``stop``.

    A day adds its revenue when it comes and takes it back at ``stop``: two rows, added up by one
    running sum per group. Between two such days the sum stands still, so each row stands for an
    interval of days, and meets just the periods that begin or go on in it. A group has no row where none of
    its days counts. A group has no more rows than the calendar has days, twice.
    """
    unit, step = _STEPS[grain]
    daily = _by_day(mart, by)
    events = daily.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("full_date").alias("begin"), F.col("revenue").alias("change"), F.lit(1).alias("days")),
                F.struct(
                    stop.alias("begin"),
                    (-F.col("revenue")).cast(daily.schema["revenue"].dataType).alias("change"),
                    F.lit(-1).alias("days"),
                ),
            )
        ),
    )
    changes = events.groupBy(*by, "begin").agg(F.sum("change").alias("change"), F.sum("days").alias("days"))
    group = Window.partitionBy(*by).orderBy("begin")
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    intervals = changes.select(
        *by,
        "begin",
        F.date_sub(F.lead("begin").over(group), 1).alias("end"),
        F.sum("change").over(so_far).alias(value),
        F.sum("days").over(so_far).alias("counting"),
    ).filter("counting > 0")
    first = F.trunc("begin", unit) if grain != "day" else F.col("begin")
    touched = intervals.withColumn("period_start", F.explode(F.sequence(first, F.col("end"), F.expr(f"INTERVAL {step}"))))
    period = GRAINS[grain]
    last = F.max("full_date").alias("last_date")
    ends = mart.dim_date.groupBy(*period).agg(last) if grain != "day" else mart.dim_date.select("full_date", F.col("full_date").alias("last_date"))
    ends = ends.withColumn("period_start", F.trunc("last_date", unit) if grain != "day" else F.col("last_date"))
    keys = [*by, *period] + (["last_date"] if grain != "day" else [])
    return (
        touched.join(ends, "period_start")
        .filter(F.col("last_date").between(F.col("begin"), F.col("end")))
        .select(*keys, value)
        .orderBy(*keys)
    )


def rolling_30d_calendar(mart: Mart, grain: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Revenue of the 30 calendar days up to the last day of the period, all orders.

    The window runs on the calendar, one row per day. With attributes, groups without revenue in
    those days have no row.
    """
    if by:
        return _counted_until(mart, by, F.date_add("full_date", 30), grain, "rolling_30d_revenue")
    window = Window.orderBy(F.unix_date("full_date")).rangeBetween(-29, 0)
    days = _by_day(mart).withColumn("rolling_30d_revenue", F.sum("revenue").over(window))
    return _last_of_period(days, grain, "rolling_30d_revenue")


def revenue_mtd(mart: Mart, grain: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Revenue since the first of the month, up to the last day of the period.

    With attributes, groups without revenue in those days have no row.
    """
    if by:
        return _counted_until(mart, by, F.date_add(F.last_day("full_date"), 1), grain, "revenue_mtd")
    window = (
        Window.partitionBy("year", "month")
        .orderBy("full_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    days = _by_day(mart).withColumn("revenue_mtd", F.sum("revenue").over(window))
    return _last_of_period(days, grain, "revenue_mtd")
