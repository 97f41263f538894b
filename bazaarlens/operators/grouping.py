"""Per-key picks, and the way rows of small groups travel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gathered(df: DataFrame, key: str) -> DataFrame:
    """The rows with all rows of a key in one partition; groups by it, and joins on it, need no other shuffle.

    For keys of a few rows each, as an order has: rows are sent as they are. Combined inside the tasks first,
    they would hardly get fewer where the rows of a key are far apart, and a task would hold as many groups as
    it reads rows, which it sorts and spills. Afterwards, a partition has the size that the planner advises.
    """
    return df.repartition(F.col(key))


def first_present(column: str, order: Sequence[str]) -> Column:
    """Aggregate: the first non-null value of ``column`` in ``order``."""
    row = F.struct(*dict.fromkeys([*order, column]))
    return F.min(F.when(F.col(column).isNotNull(), row))[column]


def most_common(column: str, times: str | None = None) -> Column:
    """Aggregate: the most frequent non-null value, the smallest one on a tie.

    Of rows that are already counted per value in the column ``times``, no group has to hold a table of its values.
    """
    if times is None:
        return F.mode(column, True)
    value = F.struct((-F.col(times)).alias("rarity"), F.col(column))
    return F.min(F.when(F.col(column).isNotNull(), value))[column]


def first_row_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key in ``order``; null keys form one group.

    The planner limits every group to its first row before the shuffle, too, so a hot key stays cheap.
    """
    columns = [c for c in df.columns if c != key]
    by = [F.col(c) for c in (*[c for c in order if c != key], *[c for c in columns if c not in order])]
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    return ranked.filter("__place = 1").drop("__place")
