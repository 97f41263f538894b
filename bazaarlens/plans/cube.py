"""The report cube: what all report series need of the fact.

Reports are sliced by year, category and state and then group by one more attribute. So the cube has
one view per attribute beside the three slicers, instead of all attributes together: its size follows
the number of values and not the number of orders. All parts of measures are additive, so a series adds
up the cells of its slice.

Distinct customers are not additive. They are counted for every slice that can be chosen, each slicer
at one value or at all, by how many orders they have in the slice.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.model import Mart
from bazaarlens.plans.star import SLICERS, VIEWS, parts, with_score
from bazaarlens.workspace import at_once, materialize, release


#: How many rows of ``_buyers`` a task counts for all slices; it holds up to a group per row and slice.
_ROWS_AT_ONCE = 60_000


def _with_attributes(mart: Mart) -> DataFrame:
    """What the cube needs of every order, with the attributes of its dimensions; unmatched keys give nulls.

    Gathered by month as the stored fact is, as the joins may scatter it: a task then meets few days, and its
    groups are few.
    """
    days = mart.dim_date.select("date_key", "year", "month", "month_name", "day_of_week")
    wide = (
        with_score(mart.fact)
        .join(days, "date_key", "left")
        .join(mart.dim_product.select("product_key", "category_en"), "product_key", "left")
        .join(mart.dim_customer.select("customer_key", "state"), "customer_key", "left")
    )
    names = dict.fromkeys([*SLICERS, *[a for own in VIEWS.values() for a in own]])
    measured = ("order_id", "customer_key", "total_payment", "total_price", "total_freight", "avg_review_score")
    return (
        wide.select(*names, *measured, F.floor(F.col("date_key") / 100).alias("month_key"))
        .hint("rebalance", F.col("month_key"))
        .drop("month_key")
    )


def _cells(wide: DataFrame) -> DataFrame:
    """``view``, its attributes and the parts of all measures; one grouping per view, combined inside each task first.

    Rows are as wide as the attributes of their view, and a task holds the groups of one view at a time.
    """
    names = list(dict.fromkeys([*SLICERS, *[a for own in VIEWS.values() for a in own]]))

    def cells_of(view: str) -> DataFrame:
        keys = [*SLICERS, *VIEWS[view]]
        grouped = wide.groupBy(*keys).agg(*[part.alias(name) for name, part in parts().items()])
        lacking = {name: F.lit(None).cast(wide.schema[name].dataType) for name in names if name not in keys}
        return grouped.select(F.lit(view).alias("view"), *[lacking.get(name, F.col(name)).alias(name) for name in names], *parts())

    return reduce(DataFrame.unionByName, [cells_of(view) for view in VIEWS])


def _orders_per_customer(wide: DataFrame) -> DataFrame:
    """``orders`` of each customer per year, category and state."""
    known = wide.filter(F.col("customer_key").isNotNull())
    return known.groupBy(*SLICERS, "customer_key").agg(F.count("order_id").alias("orders"))


def _buyers(single: DataFrame) -> DataFrame:
    """Per slice, ``order_count, customers``; ``all_`` columns tell a slicer at all from one at a missing value.

    ``single`` is the stored result of ``_orders_per_customer``. A customer's rows are sent to one task, which counts
    them for all slices, so the many rows of customer and slice are never sent.
    """
    tasks = max(1, math.ceil(single.count() / _ROWS_AT_ONCE))
    slices = [
        F.struct(F.lit(pick).alias("pick"), *[(F.col(s) if pick >> i & 1 else F.lit(None).cast(single.schema[s].dataType)).alias(s) for i, s in enumerate(SLICERS)])
        for pick in range(1 << len(SLICERS))
    ]
    per_slice = (
        single.repartition(tasks, "customer_key")
        .select("customer_key", "orders", F.inline(F.array(*slices)))
        .groupBy("customer_key", "pick", *SLICERS)
        .agg(F.sum("orders").alias("order_count"))
    )
    counted = per_slice.groupBy("pick", *SLICERS, "order_count").agg(F.count("*").alias("customers"))
    at_all = [(F.shiftright("pick", i).bitwiseAND(F.lit(1)) == 0).alias(f"all_{s}") for i, s in enumerate(SLICERS)]
    return counted.select(*SLICERS, *at_all, "order_count", "customers")


def with_cube(mart: Mart) -> Mart:
    """The mart with its report cube, stored in the shared folder."""
    wide = materialize(_with_attributes(mart), "wide")
    single = materialize(_orders_per_customer(wide), "orders-per-customer")
    stored = at_once(
        {
            "cells": lambda: materialize(_cells(wide), "cells"),
            "buyers": lambda: materialize(_buyers(single), "buyers"),
        }
    )
    release(wide, single)
    return replace(mart, cells=stored["cells"], buyers=stored["buyers"], chosen=())


def buyers_by_orders(mart: Mart) -> DataFrame:
    """``order_count, customers`` of the slice: how many customers have how many orders."""
    if mart.buyers is None:
        orders = mart.fact.filter(F.col("customer_key").isNotNull()).groupBy("customer_key")
        return orders.agg(F.count("order_id").alias("order_count")).groupBy("order_count").agg(F.count("*").alias("customers"))
    rows, chosen = mart.buyers, dict(mart.chosen)
    for slicer in SLICERS:
        rows = rows.filter(F.col(slicer) == chosen[slicer] if slicer in chosen else F.col(f"all_{slicer}"))
    return rows.select("order_count", "customers")
