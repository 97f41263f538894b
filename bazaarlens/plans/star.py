"""Reading the star: measures by any attribute, slicing, the wide view."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.numbers import SCORE_PARTS, half_even_score, score_parts
from bazaarlens.model import FACT_PARTITION, Mart

ALL = "All"

# Attribute name in a report -> (dimension, key in the fact, column of the dimension).
_FROM_DATE = {
    a: ("dim_date", "date_key", a)
    for a in ("full_date", "year", "quarter", "month", "month_name", "week", "day_of_week", "is_weekend")
}
ATTRIBUTES = {
    **_FROM_DATE,
    "category_en": ("dim_product", "product_key", "category_en"),
    "state": ("dim_customer", "customer_key", "state"),
    "city": ("dim_customer", "customer_key", "city"),
    "seller_state": ("dim_seller", "seller_key", "state"),
    "region": ("dim_geography", "geo_key", "region"),
}

# What a report can be sliced by, and the attributes that the report cube keeps beside the slicers, one view each.
SLICERS = ("year", "category_en", "state")
VIEWS = {
    "is_late": ("is_late",),
    "order_status": ("order_status",),
    "payment_type": ("payment_type",),
    "price_bucket": ("price_bucket",),
    "score": ("score",),
    "month": ("month", "month_name"),
    "weekday": ("month", "month_name", "day_of_week"),
    "delivery_days": ("delivery_days",),
    "day": ("date_key",),
}

# Additive parts of every measure: the name and how one fact row counts. They are sums, so they can
# be added up in steps. Averages are quotients of two parts; scores are counted in whole parts.
def parts() -> dict[str, Column]:
    score = F.col("avg_review_score")
    return {
        "n_rows": F.count("*"),
        "n_orders": F.count("order_id"),
        "payment_sum": F.sum("total_payment"),
        "payment_n": F.count("total_payment"),
        "price_sum": F.sum("total_price"),
        "price_n": F.count("total_price"),
        "freight_sum": F.sum("total_freight"),
        "freight_n": F.count("total_freight"),
        "days_sum": F.sum("delivery_days"),
        "days_n": F.count("delivery_days"),
        "late_sum": F.sum("is_late"),
        "late_n": F.count("is_late"),
        "score_sum": F.sum(score_parts(score)),
        "score_n": F.count(score).cast("decimal(20,0)") * F.lit(SCORE_PARTS),
    }


def _view_for(by: Sequence[str]) -> str | None:
    """The first, so smallest, view of the cube that has all attributes."""
    return next((view for view, own in VIEWS.items() if set(by) <= {*SLICERS, *own}), None)


def _totals_of_cells(mart: Mart, by: Sequence[str], view: str) -> DataFrame:
    """The parts per group, added up from the stored cells of one view."""
    cells = mart.cells.filter(F.col("view") == view)
    for slicer, value in mart.chosen:
        cells = cells.filter(F.col(slicer) == value)
    # Of no rows, counts are 0 and sums are missing.
    counts = [name for name in parts() if name.startswith("n_") or name.endswith("_n")]
    added = {name: F.sum(name) for name in parts()}
    added |= {name: F.coalesce(added[name], F.lit(0)) for name in counts}
    return cells.groupBy(*by).agg(*[part.alias(name) for name, part in added.items()])


def with_score(fact: DataFrame) -> DataFrame:
    """The fact with the mean review score as a whole number, as ``score``."""
    return fact.withColumn("score", half_even_score(F.col("avg_review_score")))


def totals(mart: Mart, by: Sequence[str] = (), keep_null_groups: bool = False) -> DataFrame:
    """The additive parts of all measures per group; unused parts are pruned by the planner.

    With a report cube, they are added up from its cells, as far as it has the attributes.

    Date attributes come from the calendar, whose size no fact can raise. For any
    other dimension the fact is first reduced to one row per surrogate key, inside each task and
    then across them, and only these rows meet the dimension. So a key that holds a third of the
    fact is one row by the time it is joined, and the join needs no other partitioning than that
    of the first step.
    """
    view = _view_for(by) if mart.cells is not None else None
    if view:
        stored = _totals_of_cells(mart, by, view)
        return stored if keep_null_groups or not by else stored.dropna(subset=list(by))
    wanted: dict[str, list[Column]] = {}
    for name in by:
        if name in ATTRIBUTES:
            dim, key, column = ATTRIBUTES[name]
            wanted.setdefault(dim, [F.col(key)]).append(F.col(column).alias(name))
    key_of = {dim: key for dim, key, _ in ATTRIBUTES.values()}
    fact = with_score(mart.fact) if "score" in by else mart.fact
    if "dim_date" in wanted:
        fact = fact.join(mart.dim_date.select(*wanted.pop("dim_date")), "date_key", "left")
    later = {name for name in by if name in ATTRIBUTES and ATTRIBUTES[name][0] in wanted}
    keys = [name for name in by if name not in later] + [key_of[dim] for dim in wanted]
    result = fact.groupBy(*keys).agg(*[part.alias(name) for name, part in parts().items()])
    if wanted:
        for dim, columns in wanted.items():
            result = result.join(getattr(mart, dim).select(*columns), key_of[dim], "left")
        result = result.groupBy(*by).agg(*[F.sum(name).alias(name) for name in parts()])
    if by and not keep_null_groups:
        result = result.dropna(subset=list(by))
    return result


def enrich(mart: Mart) -> DataFrame:
    """The fact with date, category and customer attributes; unmatched keys give nulls."""
    days = mart.dim_date.select("date_key", "year", "quarter", "month", "month_name", "day_of_week", "is_weekend")
    return (
        mart.fact.join(days, "date_key", "left")
        .join(mart.dim_product.select("product_key", "category_en"), "product_key", "left")
        .join(mart.dim_customer.select("customer_key", "state", "city"), "customer_key", "left")
    )


def slice_mart(
    mart: Mart,
    year: int | str = ALL,
    category: str = ALL,
    state: str = ALL,
) -> Mart:
    """The mart with a fact reduced to the chosen year, category and state; ``All`` keeps all.

    A year becomes a range of date keys that the parquet scan can skip by, and the folder of that
    year where the fact is stored by year; the others are semi joins with the matching part of a dimension. A report cube is sliced along.
    """
    fact = mart.fact
    if year != ALL:
        first = int(year) * 10_000
        if mart.by_year is not None:
            fact = mart.by_year.filter(F.col(FACT_PARTITION) == int(year)).drop(FACT_PARTITION)
        fact = fact.filter(F.col("date_key").between(first, first + 9_999))
    if category != ALL:
        products = mart.dim_product.filter(F.col("category_en") == category).select("product_key")
        fact = fact.join(products, "product_key", "left_semi")
    if state != ALL:
        customers = mart.dim_customer.filter(F.col("state") == state).select("customer_key")
        fact = fact.join(customers, "customer_key", "left_semi")
    sliced = mart.with_fact(fact)
    if mart.cells is None:
        return sliced
    asked = zip(SLICERS, (year if year == ALL else int(year), category, state), strict=True)
    chosen = (*mart.chosen, *[(slicer, value) for slicer, value in asked if value != ALL])
    return replace(sliced, cells=mart.cells, buyers=mart.buyers, chosen=chosen)


def slicer_values(mart: Mart) -> DataFrame:
    """Choices of each slicer: the sorted distinct values that occur in the fact."""
    years, categories, states = [
        totals(mart, [name]).select(F.lit(name).alias("slicer"), F.col(name).cast("string").alias("value"))
        for name in SLICERS
    ]
    return years.unionByName(categories).unionByName(states).orderBy("slicer", "value")


def membership(df: DataFrame, column: str, chosen: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``chosen``; an empty choice keeps all."""
    chosen = list(chosen)
    return df.filter(F.col(column).isin(*chosen)) if chosen else df


def dates_with_sales(mart: Mart) -> DataFrame:
    """Calendar days that occur in the fact."""
    return mart.dim_date.join(mart.fact.select("date_key").distinct(), "date_key", "left_semi")


def fact_with_geography(mart: Mart) -> DataFrame:
    """Place of the customer of each order."""
    places = mart.dim_geography.select("geo_key", "zip_code", F.col("state").alias("geo_state"), "region")
    return mart.fact.select("order_id", "customer_key", "geo_key").join(places, "geo_key", "left")


def rekey_customers(mart: Mart) -> Mart:
    """Count customers by person instead of by customer record.

    ``customer_key`` numbers ``customer_id``, which a source may hand out anew for every order.
    Here all records of one ``customer_unique_id`` share the least of their keys.
    """
    persons = mart.dim_customer.groupBy("customer_unique_id").agg(F.min("customer_key").alias("person_key"))
    link = (
        mart.dim_customer.filter(F.col("customer_unique_id").isNotNull())
        .join(persons, "customer_unique_id")
        .select("customer_key", "person_key")
    )
    fact = (
        mart.fact.join(link, "customer_key", "left")
        .withColumn("customer_key", F.coalesce("person_key", "customer_key"))
        .drop("person_key")
    )
    return mart.with_fact(fact)
