"""Text for display; used at the very edge only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(value: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(value.cast("double"), 2))


def millions(value: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(value.cast("double") / 1e6, 2), F.lit("M"))


def thousands(value: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(value.cast("double") / 1e3, 1), F.lit("K"))


def out_of_five(value: Column) -> Column:
    return F.concat(F.format_number(value.cast("double"), 2), F.lit(" / 5"))


def percent_1(value: Column) -> Column:
    return F.concat(F.format_number(value.cast("double"), 1), F.lit("%"))


def whole(value: Column) -> Column:
    return F.format_number(value.cast("bigint"), 0)


def decimal_1(value: Column) -> Column:
    return F.format_number(value.cast("double"), 1)


def decimal_2(value: Column) -> Column:
    return F.format_number(value.cast("double"), 2)


# Display format of each measure.
MEASURE_FORMATS: dict[str, Callable[[Column], Column]] = {
    "total_revenue": money,
    "total_orders": whole,
    "avg_order_value": money,
    "late_order_rate_pct": percent_1,
    "avg_delivery_days": decimal_1,
    "avg_review_score": decimal_2,
    "revenue_yoy_pct": percent_1,
    "rolling_30d_revenue": money,
    "revenue_mtd": money,
}


def format_measures(df: DataFrame) -> DataFrame:
    """Replace every known measure column by its display text."""
    return df.select(
        *[
            MEASURE_FORMATS[name](F.col(name)).alias(name) if name in MEASURE_FORMATS else F.col(name)
            for name in df.columns
        ]
    )
