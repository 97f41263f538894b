"""The nine raw tables, derived from generated order/line-item tables.

Every derived value is exact (decimals, integers, dates), so two engines agree on it bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.model import RAW_SCHEMAS, Mart
from bazaarlens.operators.grouping import gathered
from bazaarlens.plans.build import build_dimensions, build_fact_orders, clean
from bazaarlens.plans.cube import with_cube
from bazaarlens.plans.rfm import rfm_segments
from bazaarlens.sources.raw_csv import RAW_FILES
from bazaarlens.sources.star_store import read_star, write_star
from bazaarlens.workspace import at_once, materialize, stage_path

# Classes of an order's price, at about the quartiles of the generated orders.
PRICE_EDGES = (0, 100_000, 250_000, 400_000)
UNMAPPED_REGION = "MIDDLE EAST"
ID_TYPES = {
    "order_id": T.LongType(),
    "customer_id": T.LongType(),
    "product_id": T.LongType(),
    "seller_id": T.LongType(),
}


# Columns of the generated tables. Naming them saves a job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (
        gathered(_table(spark, sf_dir, "lineitem"), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    )
    # The day of the order is given; a time of day is added, so that elapsed days are not just
    # differences of dates.
    minutes = (F.col("o_orderkey") % 1440).cast("int")
    bought = F.col("o_orderdate") + F.make_dt_interval(mins=minutes)
    status = F.col("o_orderstatus")
    return (
        _table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .otherwise("processing")
            .alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            F.when(F.col("o_orderpriority") != "5-LOW", bought).alias("order_approved_at"),
            F.col("first_ship").alias("order_delivered_carrier_date"),
            F.col("last_ship").alias("order_delivered_customer_date"),
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias(
                "order_estimated_delivery_date"
            ),
        )
    )


def _line_price() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)")


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _line_price().cast("decimal(18,2)").alias("price"),
        (_line_price() * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,2)").alias("freight_value"),
    )


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("decimal(4,2)")
    paid = (
        _line_price()
        * (one - F.col("l_discount").cast("decimal(4,2)")).cast("decimal(4,2)")
        * (one + F.col("l_tax").cast("decimal(4,2)")).cast("decimal(4,2)")
    )
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        paid.cast("decimal(18,2)").alias("payment_value"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_partkey") % 5 + 1).cast("int").alias("review_score"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("review_comment_title"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("review_comment_message"),
    )


def _category(kind: str, brand: str) -> Column:
    """Brand and type together; parts of size 1 have none."""
    return F.when(F.col("p_size") != 1, F.concat_ws(" ", F.col(kind), F.col(brand)))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        _category("p_type", "p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.nullif(F.col("p_size"), F.lit(2)).alias("product_photos_qty"),
        price.alias("product_weight_g"),
        F.col("p_size").cast("double").alias("product_length_cm"),
        (F.col("p_size") + 1).cast("double").alias("product_height_cm"),
        (F.col("p_size") + 2).cast("double").alias("product_width_cm"),
    )


def raw_category_xlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of every category but the promotional ones."""
    part = _table(spark, sf_dir, "part").filter((F.col("p_type") != "PROMO") & (F.col("p_size") != 1))
    english = F.lower(F.concat_ws("_", "p_type", F.replace("p_brand", F.lit("#"), F.lit(""))))
    return part.select(
        _category("p_type", "p_brand").alias("product_category_name"),
        english.alias("product_category_name_english"),
    ).distinct()


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )


def _zip(nation: str, key: str) -> Column:
    """A hundred zip codes per nation."""
    return (F.col(nation) * 100 + F.col(key) % 100).cast("int")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "customer")
        .join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            _zip("c_nationkey", "c_custkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "supplier")
        .join(_nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            _zip("s_nationkey", "s_suppkey").alias("seller_zip_code_prefix"),
            F.col("r_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )


def raw_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every customer and seller: many rows per zip code, some of them equal."""
    places = (
        _table(spark, sf_dir, "customer")
        .select(
            F.col("c_nationkey").alias("nation"),
            _zip("c_nationkey", "c_custkey").alias("zip"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("city"),
        )
        .unionByName(
            _table(spark, sf_dir, "supplier").select(
                F.col("s_nationkey").alias("nation"),
                _zip("s_nationkey", "s_suppkey").alias("zip"),
                F.col("s_acctbal").alias("balance"),
                F.lit("DEPOT").alias("city"),
            )
        )
    )
    return places.join(_nations(spark, sf_dir), F.col("nation") == F.col("n_nationkey")).select(
        F.col("zip").alias("geolocation_zip_code_prefix"),
        F.floor(F.col("balance") / 1000).cast("double").alias("geolocation_lat"),
        F.col("nation").cast("double").alias("geolocation_lng"),
        F.col("city").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )


def state_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``state, region``; the nations of one region are left out and fall to the default."""
    return (
        _nations(spark, sf_dir)
        .filter(F.col("r_name") != UNMAPPED_REGION)
        .select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "orders": raw_orders(spark, sf_dir),
        "order_items": raw_order_items(spark, sf_dir),
        "products": raw_products(spark, sf_dir),
        "customers": raw_customers(spark, sf_dir),
        "sellers": raw_sellers(spark, sf_dir),
        "payments": raw_payments(spark, sf_dir),
        "reviews": raw_reviews(spark, sf_dir),
        "geo": raw_geo(spark, sf_dir),
        "category_xlat": raw_category_xlat(spark, sf_dir),
    }


def write_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """Run the whole build once and store the star schema in the shared folder."""
    tables = clean(raw_tables(spark, sf_dir))
    dims = build_dimensions(tables, state_regions(spark, sf_dir))
    fact = build_fact_orders(
        tables,
        dims["dim_customer"],
        dims["dim_product"],
        dims["dim_seller"],
        dims["dim_geography"],
        PRICE_EDGES,
    )
    folder = stage_path(spark, "star")
    write_star(Mart(fact=fact, **dims), folder)
    return read_star(spark, folder, id_types=ID_TYPES)


def write_raw_files(spark: SparkSession, sf_dir: str, damaged: bool = False) -> str:
    """The raw tables as CSV files below a new shared folder, with further columns empty; returns the folder.

    With ``damaged``, some cells hold what is no time, no amount or no whole number.
    """
    folder = stage_path(spark, "raw-files")
    tables = raw_tables(spark, sf_dir)
    if damaged:
        status, line, photos = F.col("order_status"), F.col("order_item_id"), F.col("product_photos_qty")
        approved, price = F.col("order_approved_at").cast("string"), F.col("price").cast("string")
        bad = {
            "orders": {"order_approved_at": F.when(status == "processing", "soon").otherwise(approved)},
            "order_items": {"price": F.when(line == 3, F.concat(price, F.lit(" R$"))).otherwise(price)},
            "products": {"product_photos_qty": F.when(photos == 5, "5.5").otherwise(photos.cast("string"))},
        }
        tables = {name: tables[name].withColumns(columns) for name, columns in bad.items()}

    def step(name: str, df: DataFrame):
        lacking = [c for c in RAW_SCHEMAS[name].names if c not in df.columns]
        full = df.withColumns({c: F.lit(None).cast("string") for c in lacking})
        return lambda: full.write.options(header=True, escape='"').csv(f"{folder}/{RAW_FILES[name].lstrip('*')}")

    at_once({name: step(name, df) for name, df in tables.items()})
    return folder


_MARTS: dict[tuple[str, str], Mart] = {}
_CUBES: dict[tuple[str, str], Mart] = {}
_SEGMENTED: dict[tuple[str, str], DataFrame] = {}


def _place(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.conf.get("spark.app.id"), sf_dir.rstrip("/")


def open_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The stored star schema of this application, built on first use."""
    place = _place(spark, sf_dir)
    if place not in _MARTS:
        _MARTS[place] = write_mart(spark, sf_dir)
    return _MARTS[place]


def open_cube(spark: SparkSession, sf_dir: str) -> Mart:
    """The stored star schema with its report cube, made on first use."""
    place = _place(spark, sf_dir)
    if place not in _CUBES:
        _CUBES[place] = with_cube(open_mart(spark, sf_dir))
    return _CUBES[place]


def open_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored customer segmentation of this application, made on first use."""
    place = _place(spark, sf_dir)
    if place not in _SEGMENTED:
        _SEGMENTED[place] = materialize(rfm_segments(open_mart(spark, sf_dir)), "result-rfm")
    return _SEGMENTED[place]
