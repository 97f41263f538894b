"""The data model: raw tables, star schema, and the fixed values that belong to them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.functions.numbers import MONEY

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _DATE, _B = T.TimestampNTZType(), T.DateType(), T.BooleanType()

# Optional column of a raw table: the place of the row in its source. Where it exists, "first" and
# the numbering of dimension rows follow it; otherwise they follow the natural key.
SOURCE_ORDER = "_source_order"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Raw tables and the columns the star schema needs (files may hold more).
RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_TS,
        order_approved_at=_TS, order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS, order_estimated_delivery_date=_TS,
    ),
    "order_items": _schema(
        order_id=_S, order_item_id=_I, product_id=_S, seller_id=_S, price=MONEY, freight_value=MONEY,
    ),
    "products": _schema(
        product_id=_S, product_category_name=_S, product_name_lenght=_I,
        product_description_lenght=_I, product_photos_qty=_I, product_weight_g=_D,
        product_length_cm=_D, product_height_cm=_D, product_width_cm=_D,
    ),
    "customers": _schema(
        customer_id=_S, customer_unique_id=_S, customer_zip_code_prefix=_I,
        customer_city=_S, customer_state=_S,
    ),
    "sellers": _schema(seller_id=_S, seller_zip_code_prefix=_I, seller_city=_S, seller_state=_S),
    "payments": _schema(
        order_id=_S, payment_type=_S, payment_installments=_I, payment_value=MONEY,
    ),
    "reviews": _schema(
        order_id=_S, review_score=_I, review_comment_title=_S, review_comment_message=_S,
    ),
    "geo": _schema(
        geolocation_zip_code_prefix=_I, geolocation_lat=_D, geolocation_lng=_D,
        geolocation_city=_S, geolocation_state=_S,
    ),
    "category_xlat": _schema(product_category_name=_S, product_category_name_english=_S),
}

# Columns of the star schema, in output order.
STAR_SCHEMAS: dict[str, T.StructType] = {
    "dim_date": _schema(
        full_date=_DATE, date_key=_I, year=_I, quarter=_I, month=_I, month_name=_S,
        week=_I, day_of_week=_S, is_weekend=_B,
    ),
    "dim_customer": _schema(
        customer_key=_L, customer_id=_S, customer_unique_id=_S, zip_code=_I, city=_S, state=_S,
    ),
    "dim_product": _schema(
        product_key=_L, product_id=_S, category_en=_S, weight_g=_D, length_cm=_D,
        height_cm=_D, width_cm=_D,
    ),
    "dim_seller": _schema(seller_key=_L, seller_id=_S, zip_code=_I, city=_S, state=_S),
    "dim_geography": _schema(
        geo_key=_L, zip_code=_I, city=_S, state=_S, region=_S, lat=_D, lng=_D,
    ),
    "fact_orders": _schema(
        order_id=_S, date_key=_I, customer_key=_L, product_key=_L, seller_key=_L, geo_key=_L,
        order_status=_S, total_price=MONEY, total_freight=MONEY, total_payment=MONEY,
        qty=_L, num_installments=_I, payment_type=_S, delivery_days=_L, is_late=_I,
        avg_review_score=_D, price_bucket=_S,
    ),
}

# Labels and lower ends of the order price classes.
PRICE_LABELS = ("budget", "mid-range", "premium", "luxury")
PRICE_EDGES = (0, 50, 150, 500)

# Region of each state; any other state belongs to OTHER_REGION.
OTHER_REGION = "Other"
STATE_REGIONS = {
    "SP": "Southeast", "RJ": "Southeast", "MG": "Southeast", "ES": "Southeast",
    "RS": "South", "SC": "South", "PR": "South",
    "BA": "Northeast", "PE": "Northeast", "CE": "Northeast", "MA": "Northeast",
    "PA": "North", "AM": "North", "RO": "North",
    "DF": "Central-West", "GO": "Central-West", "MT": "Central-West", "MS": "Central-West",
}

# The customer segments, best first.
SEGMENTS = (
    "Champions", "Loyal Customers", "Recent Customers", "Potential Loyalists",
    "At Risk", "Cannot Lose Them", "Hibernating", "Need Attention",
)

DELIVERED = "delivered"


#: The stored fact has a folder per year of its calendar day; the column that names the folder is no attribute of an order.
FACT_PARTITION = "order_year"


@dataclass(frozen=True)
class Mart:
    """The star schema: one row per order in ``fact``, five dimensions around it.

    ``cells`` and ``buyers`` are the report cube of the fact, if it was built (see ``plans.cube``), and
    ``chosen`` the slice that was taken of it. ``by_year`` is the fact with ``FACT_PARTITION``, where it is
    stored by year. Another fact has neither.
    """

    fact: DataFrame
    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_seller: DataFrame
    dim_geography: DataFrame
    cells: DataFrame | None = None
    buyers: DataFrame | None = None
    chosen: tuple[tuple[str, int | str], ...] = ()
    by_year: DataFrame | None = None

    def with_fact(self, fact: DataFrame) -> Mart:
        return replace(self, fact=fact, cells=None, buyers=None, chosen=(), by_year=None)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_date": self.dim_date,
            "dim_customer": self.dim_customer,
            "dim_product": self.dim_product,
            "dim_seller": self.dim_seller,
            "dim_geography": self.dim_geography,
            "fact_orders": self.fact,
        }

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> Mart:
        dims = {name: df for name, df in tables.items() if name != "fact_orders"}
        fact = tables["fact_orders"]
        by_year = fact if FACT_PARTITION in fact.columns else None
        return cls(fact=fact.drop(FACT_PARTITION), by_year=by_year, **dims)
