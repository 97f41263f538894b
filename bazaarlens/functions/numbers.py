"""Rounding, division and bucketing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# A mean of up to twenty whole scores is a whole number of these parts: the least common multiple of 1 to 20.
SCORE_PARTS = 232_792_560


def round2(value: Column) -> Column:
    """Round a double to two digits, halves away from zero."""
    value = value.cast("double")
    return F.signum(value) * F.floor(F.abs(value) * 100 + 0.5) / 100


def sum_money(amount: Column) -> Column:
    """Aggregate: exact sum of a two-digit decimal per order, customer or other small unit.

    Summed in whole cents: with many groups that is about twice as fast as a sum of decimals, whose
    wide buffers are updated row by row. A sum beyond 64 bits is an error in ANSI mode, never a
    wrong number; totals over the whole table are summed as decimals.
    """
    cents = F.sum((amount * 100).cast("bigint"))
    return (cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def score_parts(mean: Column) -> Column:
    """A mean score in whole parts, so that sums are exact in any order; means of more than twenty scores to the nearest part."""
    return F.round(mean.cast("double") * SCORE_PARTS).cast("decimal(20,0)")


def mean_in_order(values: Column) -> Column:
    """Mean of the few structs of an array, by their last field ``value``, added up in the order of their other fields.

    A sum of doubles depends on the order, which an aggregate does not fix.
    """
    present = F.filter(values, lambda v: v["value"].isNotNull())
    total = F.aggregate(F.sort_array(present), F.lit(0.0), lambda sum_, v: sum_ + v["value"])
    return ratio(total, F.size(present))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as doubles; null when the denominator is null or zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def safe_divide(numerator: Column, denominator: Column, alternate: float = 0.0) -> Column:
    """Division as doubles that yields ``alternate`` where no quotient exists."""
    return F.coalesce(ratio(numerator, denominator), F.lit(float(alternate)))


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; null when ``whole`` is zero."""
    return ratio(part.cast("double") * 100.0, whole)


def zero_if_null(value: Column) -> Column:
    """An empty or all-null sum counts as 0."""
    return F.coalesce(value, F.lit(0).cast(T.DecimalType(38, 2)))


def right_closed_bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i + 1]]``; the last interval has no upper end.

    Null, and anything at or below the first edge, gets no label.
    """
    if len(edges) != len(labels):
        raise ValueError("give one lower edge per label")
    branch = F.when(value.isNull() | (value <= F.lit(edges[0])), F.lit(None).cast("string"))
    for label, upper in zip(labels, edges[1:]):
        branch = branch.when(value <= F.lit(upper), F.lit(label))
    return branch.otherwise(F.lit(labels[-1]))


def half_even_score(score: Column) -> Column:
    """Nearest whole score; a half goes to the even neighbour."""
    return F.bround(score, 0).cast("int")


def late_status(rate: Column, good: float = 5.0, watch: float = 10.0) -> Column:
    """Traffic light for a late rate in percent."""
    return F.when(rate <= good, "Good").when(rate <= watch, "Watch").otherwise("Critical")


def benchmark_side(rate: Column, benchmark: float = 7.9) -> Column:
    """Whether a rate lies above a fixed benchmark; equal or unknown counts as below."""
    return F.when(rate > benchmark, "Above").otherwise("Below")
