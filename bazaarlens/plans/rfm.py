"""Recency, frequency and monetary value of customers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.display import money
from bazaarlens.functions.numbers import SCORE_PARTS, ratio, round2, score_parts, sum_money, zero_if_null
from bazaarlens.model import SEGMENTS, Mart
from bazaarlens.operators.distribution import counted_shares
from bazaarlens.operators.ranking import top_k, with_tiles
from bazaarlens.plans.star import membership
from bazaarlens.workspace import materialize

# The columns of the result, in order.
RESULT_COLUMNS = (
    "customer_key", "city", "state", "recency_days", "frequency", "monetary", "avg_order_value",
    "avg_review_score", "last_order_date", "r_score", "f_score", "m_score", "rfm_score",
    "total_rfm_score", "segment",
)


def rfm_metrics(mart: Mart) -> DataFrame:
    """One row per known customer with orders.

    The fact has one row per order, so orders are counted without telling them apart; they are aggregated before the customer table is joined. The snapshot date
    is the last day with any order, also of an unknown customer; it is read off the aggregated
    rows, so the fact is scanned once.
    """
    days = mart.dim_date.select("date_key", "full_date")
    score = F.col("avg_review_score")
    per_customer = (
        mart.fact.join(days, "date_key")
        .groupBy("customer_key")
        .agg(
            F.max("full_date").alias("last_order_date"),
            F.count("order_id").alias("frequency"),
            sum_money(F.col("total_payment")).alias("monetary"),
            F.count("total_payment").alias("paid"),
            F.sum(score_parts(score)).alias("score_sum"),
            F.count(score).alias("scored"),
        )
    )
    people = mart.dim_customer.select("customer_key", "city", "state", F.lit(True).alias("known"))
    stored = materialize(per_customer.join(people, "customer_key", "left"), "rfm-metrics")
    snapshot = stored.agg(F.max("last_order_date")).scalar()
    return stored.filter("known").select(
        "customer_key",
        "city",
        "state",
        F.date_diff(snapshot, F.col("last_order_date")).cast("bigint").alias("recency_days"),
        "frequency",
        "monetary",
        round2(ratio(F.col("monetary"), F.col("paid"))).alias("avg_order_value"),
        round2(ratio(F.col("score_sum"), F.col("scored") * SCORE_PARTS)).alias("avg_review_score"),
        "last_order_date",
    )


def rfm_scores(mart: Mart) -> DataFrame:
    """Quarter of the customers each belongs to, 4 the best, ties by customer key."""
    return with_tiles(
        rfm_metrics(mart),
        {
            "r_score": -F.col("recency_days"),
            "f_score": F.col("frequency"),
            "m_score": F.col("monetary"),
        },
        key="customer_key",
    )


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment by scores; the first rule that fits decides. Thresholds and their order are fixed values.

    ``Cannot Lose Them`` never applies, as every such customer is ``At Risk`` before.
    """
    champions, loyal, recent, potential, at_risk, cannot_lose, hibernating, attention = SEGMENTS
    return (
        F.when((r == 4) & (f == 4) & (m == 4), champions)
        .when((r >= 3) & (f >= 3), loyal)
        .when((r == 4) & (f <= 2), recent)
        .when((r >= 3) & (f <= 2) & (m >= 3), potential)
        .when((r == 1) & (f >= 3), at_risk)
        .when((r == 1) & (f == 4) & (m == 4), cannot_lose)
        .when((r <= 2) & (f <= 2), hibernating)
        .otherwise(attention)
    )


def rfm_segments(mart: Mart) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        rfm_scores(mart)
        .withColumns(
            {
                "rfm_score": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
                "total_rfm_score": r + f + m,
                "segment": segment_of(r, f, m),
            }
        )
        .select(*RESULT_COLUMNS)
        .orderBy(F.desc_nulls_last("total_rfm_score"), F.desc_nulls_last("monetary"), "customer_key")
    )


# The reports below take the stored result of rfm_segments.


def segment_distribution(rfm: DataFrame, segments: Iterable[str] = ()) -> DataFrame:
    return counted_shares(membership(rfm, "segment", segments), "segment", "customers")


def segment_revenue(rfm: DataFrame, segments: Iterable[str] = ()) -> DataFrame:
    return (
        membership(rfm, "segment", segments)
        .groupBy("segment")
        .agg(zero_if_null(F.sum("monetary")).alias("total_spend"))
        .orderBy("total_spend", "segment")
    )


def top_customers(rfm: DataFrame, k: int = 20, segments: Iterable[str] = ()) -> DataFrame:
    """The customers who spent most, with the amount as text."""
    columns = (
        "customer_key", "city", "state", "recency_days", "frequency", "monetary", "segment",
        "r_score", "f_score", "m_score",
    )
    best = top_k(
        membership(rfm, "segment", segments), k, F.desc_nulls_last("monetary"), F.asc("customer_key")
    )
    return best.select(*[money(F.col(c)).alias(c) if c == "monetary" else F.col(c) for c in columns])


def customer_kpis(rfm: DataFrame) -> DataFrame:
    """Size of the base and of the segments the customer page puts first."""

    def in_segment(name: str) -> Column:
        return F.count_if(F.col("segment") == name)

    return rfm.agg(
        F.count("*").alias("total_customers"),
        in_segment("Champions").alias("champions"),
        (ratio(in_segment("Champions"), F.count("*")) * 100).alias("champions_pct"),
        in_segment("At Risk").alias("at_risk"),
        (ratio(in_segment("At Risk"), F.count("*")) * 100).alias("at_risk_pct"),
    )
