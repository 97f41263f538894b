"""Histograms, shares and completion of sparse groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of(value: Column, by: Sequence[str] = ()) -> Column:
    """``value`` as a percentage of its total. For aggregated rows only: the window is one task."""
    whole = F.sum(value).over(Window.partitionBy(*by))
    return value.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def counted_shares(df: DataFrame, label: str, count: str) -> DataFrame:
    """Rows per non-null label with their share, the most frequent first."""
    return with_shares(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(count)), label, count)


def with_shares(counts: DataFrame, label: str, count: str) -> DataFrame:
    """Counts with their share, the most frequent first."""
    return counts.withColumn("share_pct", share_of(F.col(count))).orderBy(F.desc(count), label)


def equal_width_histogram(
    counts: DataFrame, value: str, count: str, bins: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``bins`` equal intervals between the least and the largest value; the last one is closed.

    ``counts`` holds one row per distinct whole number (its range bounds its size), so the bounds
    come from a window over it and the data is read once. Integer arithmetic places every value
    exactly. Without values there are no bins; with one distinct value the range is widened by a
    half to both sides. ``keep`` names columns that are the same in all rows and stay.
    """
    everywhere = Window.partitionBy()
    low, high = F.min(value).over(everywhere), F.max(value).over(everywhere)
    # Bounds are doubled, so that the widened range stays in whole numbers.
    widen = F.when(low == high, 1).otherwise(0)
    shared = ["low2", "high2", *keep]
    offset = (F.col(value) * 2 - F.col("low2")) * bins
    last = F.lit(bins - 1).cast("bigint")
    placed = (
        counts.select(
            value, count, *keep, (low * 2 - widen).alias("low2"), (high * 2 + widen).alias("high2")
        )
        .withColumn(
            "bin", F.least(F.call_function("div", offset, F.col("high2") - F.col("low2")), last).cast("int")
        )
        .groupBy(*shared, "bin")
        .agg(F.sum(count).alias(count))
    )
    # One row with at most ``bins`` entries, spread over all bins, also those without rows.
    entries = F.collect_list(F.struct("bin", count))
    spread = (
        placed.groupBy(*shared)
        .agg(F.map_from_entries(entries).alias("filled"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    width2 = (F.col("high2") - F.col("low2")).cast("double")
    return spread.select(
        "bin",
        ((F.col("low2") + width2 * F.col("bin") / bins) / 2).alias("bin_start"),
        ((F.col("low2") + width2 * (F.col("bin") + 1) / bins) / 2).alias("bin_end"),
        F.coalesce(F.element_at("filled", F.col("bin")), F.lit(0)).cast("bigint").alias(count),
        *keep,
    ).orderBy("bin")


def in_fixed_order(df: DataFrame, column: str, ordered: Sequence[str]) -> DataFrame:
    """One row per value of a short fixed list, in list order, absent ones with null measures."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in ordered])).alias("pos", column))
    placed = spine.join(df, column, "left").withColumn("position", F.col("pos") + 1).orderBy("position")
    return placed.select(column, "position", *[c for c in df.columns if c != column])
