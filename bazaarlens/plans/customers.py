"""Buyers, reviews, payments and order status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.numbers import percent, zero_if_null
from bazaarlens.model import DELIVERED, Mart
from bazaarlens.operators.distribution import share_of, with_shares
from bazaarlens.plans.cube import buyers_by_orders
from bazaarlens.plans.star import totals


def repeat_buyers(mart: Mart) -> DataFrame:
    """Customers with one order and with more."""
    kind = F.when(F.col("order_count") == 1, "One-time").otherwise("Repeat")
    counted = buyers_by_orders(mart).groupBy(kind.alias("buyer_type")).agg(F.sum("customers").alias("customers"))
    return with_shares(counted, "buyer_type", "customers")


def repeat_order_histogram(mart: Mart) -> DataFrame:
    """Repeat buyers by every number of orders from two to the largest; no rows where nobody came back.

    The window has one row per number that occurs; the numbers between are made from the gap before.
    """
    counts = buyers_by_orders(mart).filter("order_count > 1").toDF("at", "found")
    before = F.coalesce(F.lag("at").over(Window.orderBy("at")), F.lit(1))
    return (
        counts.withColumn("before", before)
        .select("at", "found", F.explode(F.sequence(F.col("before") + 1, F.col("at"))).alias("order_count"))
        .select("order_count", F.when(F.col("order_count") == F.col("at"), F.col("found")).otherwise(F.lit(0)).alias("customers"))
        .orderBy("order_count")
    )


def review_distribution(mart: Mart) -> DataFrame:
    """Orders by rounded mean score; scores below four are flagged."""
    counts = totals(mart, ["score"]).select("score", F.col("n_rows").alias("orders"))
    return counts.withColumn("is_low", F.col("score") < 4).orderBy("score")


def five_star_pct(mart: Mart) -> DataFrame:
    five = F.sum(F.when(F.col("score") == 5, F.col("orders")).otherwise(0))
    return review_distribution(mart).agg(percent(five, F.sum("orders")).alias("five_star_pct"))


def payment_type_split(mart: Mart) -> DataFrame:
    return (
        totals(mart, ["payment_type"])
        .select(
            "payment_type",
            F.col("n_orders").alias("orders"),
            zero_if_null(F.col("payment_sum")).alias("revenue"),
        )
        .orderBy(F.desc("orders"), "payment_type")
    )


def order_status_breakdown(mart: Mart) -> DataFrame:
    counts = totals(mart, ["order_status"]).select("order_status", F.col("n_rows").alias("orders"))
    return counts.select(
        "order_status",
        "orders",
        share_of(F.col("orders")).alias("share_pct"),
        (F.col("order_status") == DELIVERED).alias("is_delivered"),
    ).orderBy(F.desc("orders"), "order_status")
