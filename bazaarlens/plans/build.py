"""Raw tables to star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import dates, numbers
from bazaarlens.model import (
    OTHER_REGION,
    PRICE_EDGES,
    PRICE_LABELS,
    SOURCE_ORDER,
    STATE_REGIONS,
    STAR_SCHEMAS,
    Mart,
)
from bazaarlens.operators.grouping import first_present, first_row_per_key, gathered, most_common
from bazaarlens.operators.ranking import dense_index, file_index
from bazaarlens.workspace import at_once

Tables = Mapping[str, DataFrame]


def _row_order(df: DataFrame, natural: Sequence[str]) -> list[str]:
    """Columns that put the rows of a raw table in order.

    The place in the source where it is known, else the natural key; should a key come twice, the
    other columns decide, so that only equal rows are left in any order.
    """
    if SOURCE_ORDER in df.columns:
        return [SOURCE_ORDER]
    return [*natural, *(c for c in df.columns if c not in natural)]


def _numbered(df: DataFrame, natural: Sequence[str], name: str, whole: bool = False) -> DataFrame:
    """Rows numbered in their order; see ``file_index`` for ``whole``."""
    if SOURCE_ORDER in df.columns:
        return file_index(df, SOURCE_ORDER, name, whole)
    return dense_index(df, [F.col(c) for c in _row_order(df, natural)], name)


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """Columns of a star table in their order."""
    return df.select(*STAR_SCHEMAS[table].names)


def fill_delivery_date(orders: DataFrame) -> DataFrame:
    """An order without a delivery date counts as delivered on its estimated date."""
    return orders.withColumn(
        "order_delivered_customer_date",
        F.coalesce("order_delivered_customer_date", "order_estimated_delivery_date"),
    )


def fill_category(products: DataFrame) -> DataFrame:
    return products.fillna({"product_category_name": "unknown"})


def fill_comments(reviews: DataFrame) -> DataFrame:
    return reviews.fillna({"review_comment_title": "", "review_comment_message": ""})


GEO_ORDER = ("geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state")


def first_geo_per_zip(geo: DataFrame) -> DataFrame:
    zip_code = "geolocation_zip_code_prefix"
    order = [c for c in _row_order(geo, GEO_ORDER) if c != zip_code]
    return first_row_per_key(geo, zip_code, order)


def clean(raw: Tables) -> dict[str, DataFrame]:
    """The raw tables with the fixes applied."""
    return {
        **raw,
        "orders": fill_delivery_date(raw["orders"]),
        "products": fill_category(raw["products"]),
        "reviews": fill_comments(raw["reviews"]),
        "geo": first_geo_per_zip(raw["geo"]),
    }


def calendar(span: DataFrame, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """One row per day between two dates given in a one-row frame."""
    day = F.col("full_date")
    return span.select(F.explode(F.sequence(first, last)).alias("full_date")).select(
        day,
        dates.date_key(day).alias("date_key"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.weekofyear(day).alias("week"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        (F.weekday(day) >= 5).alias("is_weekend"),
    )


def build_dim_date(orders: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last purchase."""
    bought = F.to_date("order_purchase_timestamp")
    span = orders.agg(F.min(bought).alias("first_day"), F.max(bought).alias("last_day"))
    return calendar(span.filter("first_day IS NOT NULL"))


def build_dim_customer(customers: DataFrame) -> DataFrame:
    named = customers.withColumnsRenamed(
        {"customer_zip_code_prefix": "zip_code", "customer_city": "city", "customer_state": "state"}
    )
    return _shaped(_numbered(named, ["customer_id"], "customer_key", whole=True), "dim_customer")


def build_dim_product(products: DataFrame, category_xlat: DataFrame) -> DataFrame:
    """Category in English, or as given where no translation exists."""
    named = (
        products.join(category_xlat.drop(SOURCE_ORDER), "product_category_name", "left")
        .withColumn("category_en", F.coalesce("product_category_name_english", "product_category_name"))
        .withColumnsRenamed(
            {
                "product_weight_g": "weight_g",
                "product_length_cm": "length_cm",
                "product_height_cm": "height_cm",
                "product_width_cm": "width_cm",
            }
        )
    )
    wanted = {SOURCE_ORDER, *STAR_SCHEMAS["dim_product"].names}
    slim = named.select(*[c for c in named.columns if c in wanted])
    return _shaped(_numbered(slim, ["product_id"], "product_key"), "dim_product")


def build_dim_seller(sellers: DataFrame) -> DataFrame:
    named = sellers.withColumnsRenamed(
        {"seller_zip_code_prefix": "zip_code", "seller_city": "city", "seller_state": "state"}
    )
    return _shaped(_numbered(named, ["seller_id"], "seller_key", whole=True), "dim_seller")


def with_region(df: DataFrame, regions: DataFrame | Mapping[str, str] = STATE_REGIONS) -> DataFrame:
    """Add ``region`` by ``state``, from a mapping or from a frame ``(state, region)``."""
    if not isinstance(regions, DataFrame):
        pairs = [F.struct(F.lit(s).alias("state"), F.lit(r).alias("region")) for s, r in regions.items()]
        regions = df.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    joined = df.join(regions, "state", "left")
    return joined.withColumn("region", F.coalesce("region", F.lit(OTHER_REGION)))


def build_dim_geography(
    geo: DataFrame, regions: DataFrame | Mapping[str, str] = STATE_REGIONS
) -> DataFrame:
    """``geo`` must hold one row per zip code already."""
    named = geo.withColumnsRenamed(
        {
            "geolocation_zip_code_prefix": "zip_code",
            "geolocation_lat": "lat",
            "geolocation_lng": "lng",
            "geolocation_city": "city",
            "geolocation_state": "state",
        }
    )
    return _shaped(_numbered(with_region(named, regions), ["zip_code"], "geo_key"), "dim_geography")


def payments_per_order(payments: DataFrame) -> DataFrame:
    # Counted per order and type, so that no group holds a table of its types.
    per_type = (
        gathered(payments, "order_id")
        .groupBy("order_id", "payment_type")
        .agg(
            # Amounts that are all missing add up to 0.
            numbers.sum_money(F.coalesce("payment_value", F.lit(0))).alias("amount"),
            F.max("payment_installments").alias("installments"),
            F.count("*").alias("times"),
        )
    )
    return per_type.groupBy("order_id").agg(
        numbers.sum_money(F.col("amount")).alias("total_payment"),
        F.max("installments").alias("num_installments"),
        most_common("payment_type", "times").alias("payment_type"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return gathered(reviews, "order_id").groupBy("order_id").agg(F.avg("review_score").alias("avg_review_score"))


ITEM_ORDER = ("order_item_id", "product_id", "seller_id")


def items_per_order(order_items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """First product and seller (in source order where known), money sums and item count."""
    by = [SOURCE_ORDER] if SOURCE_ORDER in order_items.columns else list(order)
    return gathered(order_items, "order_id").groupBy("order_id").agg(
        first_present("product_id", by).alias("product_id"),
        first_present("seller_id", by).alias("seller_id"),
        numbers.sum_money(F.coalesce("freight_value", F.lit(0))).alias("total_freight"),
        numbers.sum_money(F.coalesce("price", F.lit(0))).alias("total_price"),
        F.count("order_item_id").alias("qty"),
    )


def build_fact_orders(
    tables: Tables,
    dim_customer: DataFrame,
    dim_product: DataFrame,
    dim_seller: DataFrame,
    dim_geography: DataFrame,
    price_edges: Sequence[float] = PRICE_EDGES,
) -> DataFrame:
    """One row per order, none lost and none multiplied.

    ``tables`` are the cleaned raw tables. Everything with many rows per order is aggregated first,
    so each join adds at most one row. Surrogate keys are looked up on the narrow sides (orders for
    the customer, items for product and seller) before the wide join, which is keyed by order only:
    the three aggregates arrive there already partitioned by it. Lookups whose dimension is small
    become broadcasts at run time; a hot customer, product or missing key in the others is split by
    the adaptive skew join, as every lookup keeps its left side.
    """
    customers = dim_customer.select("customer_id", "customer_key", "zip_code").join(
        dim_geography.select("zip_code", "geo_key"), "zip_code", "left"
    )
    bought, delivered, promised = (
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
    )
    orders = (
        tables["orders"]
        .select(
            "order_id",
            "customer_id",
            "order_status",
            dates.date_key(bought).alias("date_key"),
            dates.elapsed_days(bought, delivered).alias("delivery_days"),
            F.coalesce((delivered > promised).cast("int"), F.lit(0)).alias("is_late"),
        )
        .join(customers.drop("zip_code"), "customer_id", "left")
    )
    items = (
        items_per_order(tables["order_items"])
        .join(dim_product.select("product_id", "product_key"), "product_id", "left")
        .join(dim_seller.select("seller_id", "seller_key"), "seller_id", "left")
    )
    fact = (
        orders.join(items, "order_id", "left")
        .join(payments_per_order(tables["payments"]), "order_id", "left")
        .join(reviews_per_order(tables["reviews"]), "order_id", "left")
        .withColumn(
            "price_bucket", numbers.right_closed_bucket(F.col("total_price"), price_edges, PRICE_LABELS)
        )
    )
    return _shaped(fact, "fact_orders")


def build_dimensions(
    tables: Tables, regions: DataFrame | Mapping[str, str] = STATE_REGIONS
) -> dict[str, DataFrame]:
    """The five dimensions; numbering their rows runs jobs, which do not depend on each other."""
    return at_once(
        {
            "dim_date": lambda: build_dim_date(tables["orders"]),
            "dim_customer": lambda: build_dim_customer(tables["customers"]),
            "dim_product": lambda: build_dim_product(tables["products"], tables["category_xlat"]),
            "dim_seller": lambda: build_dim_seller(tables["sellers"]),
            "dim_geography": lambda: build_dim_geography(tables["geo"], regions),
        }
    )


def build_mart(
    raw: Tables,
    regions: DataFrame | Mapping[str, str] = STATE_REGIONS,
    price_edges: Sequence[float] = PRICE_EDGES,
) -> Mart:
    """Clean the raw tables and derive the star schema."""
    tables = clean(raw)
    dims = build_dimensions(tables, regions)
    fact = build_fact_orders(
        tables,
        dims["dim_customer"],
        dims["dim_product"],
        dims["dim_seller"],
        dims["dim_geography"],
        price_edges,
    )
    return Mart(fact=fact, **dims)
