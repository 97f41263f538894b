"""Registered queries, and the SQL that says what each of them must return.

Queries on raw tables and on the build of the star schema start from the generated tables. All
others read the star schema, which an application builds once and keeps in the shared folder.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)

from bazaarlens.functions import display  # noqa: E402
from bazaarlens.model import Mart  # noqa: E402
from bazaarlens.operators import quality  # noqa: E402
from bazaarlens.plans import (  # noqa: E402
    build,
    cohort,
    customers,
    dashboard,
    delivery,
    measures,
    revenue,
    rfm,
    star,
)
from bazaarlens.sources import generated, raw_csv, star_store  # noqa: E402
from bazaarlens.workspace import stage_path  # noqa: E402
from oracle.checks import CHOSEN_SEGMENTS, STATEMENTS  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


def _importable(query: Query) -> Query:
    """Let Python workers find this library where no zip of it was submitted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


try:
    from bazaarlens.llm.queries import QUERIES as TEXT_QUERIES
    from bazaarlens.llm.statements import STATEMENTS as TEXT_STATEMENTS
    from corpus_pipeline import ORACLE_SQL, run as run_pipeline
except ModuleNotFoundError as missing:
    # The text operators are a part of their own and may be left out as a whole. Where a package they
    # need is missing, they are missing, too, and all other queries stay.
    if missing.name not in ("bazaarlens.llm", "bazaarlens.llm.queries", "bazaarlens.llm.statements", "corpus_pipeline"):
        warnings.warn(f"no text queries: {missing}", stacklevel=1)
    TEXT_QUERIES, TEXT_STATEMENTS = {}, {}
else:
    TEXT_QUERIES = {name: _importable(query) for name, query in {**TEXT_QUERIES, "pipeline": run_pipeline}.items()}
    TEXT_STATEMENTS = {**TEXT_STATEMENTS, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _plain(df: DataFrame) -> DataFrame:
    """Exact money becomes double at the very end."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _on_raw(make: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(make(generated.raw_tables(spark, sf_dir)))


def _on_clean(make: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return _on_raw(lambda raw: make(build.clean(raw)))


def _on_mart(make: Callable[[Mart], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(make(generated.open_mart(spark, sf_dir)))


def _on_rfm(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(make(generated.open_segments(spark, sf_dir)))


def _filled_defaults(raw: dict[str, DataFrame]) -> DataFrame:
    """Values of the filled columns with their row counts."""

    def counted(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count")).select(
            F.lit(column).alias("column_name"), "value", "row_count"
        )

    reviews = build.fill_comments(raw["reviews"])
    return (
        counted(build.fill_category(raw["products"]), "product_category_name")
        .unionByName(counted(reviews, "review_comment_title"))
        .unionByName(counted(reviews, "review_comment_message"))
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = generated.raw_customers(spark, sf_dir).select(F.col("customer_state").alias("state"))
    counted = people.groupBy("state").agg(F.count("*").alias("customers"))
    return build.with_region(counted, generated.state_regions(spark, sf_dir)).select("state", "region", "customers")


def _fact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = generated.open_mart(spark, sf_dir)
    fact = build.build_fact_orders(
        build.clean(generated.raw_tables(spark, sf_dir)),
        mart.dim_customer,
        mart.dim_product,
        mart.dim_seller,
        mart.dim_geography,
        generated.PRICE_EDGES,
    )
    return _plain(fact)


def _dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = build.first_geo_per_zip(generated.raw_geo(spark, sf_dir))
    return build.build_dim_geography(geo, generated.state_regions(spark, sf_dir))


def _share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart, segments = generated.open_mart(spark, sf_dir), generated.open_segments(spark, sf_dir)
    return _plain(dashboard.share_of_total(mart, segments))


def _slice(mart: Mart) -> Mart:
    return star.slice_mart(mart, year=1997, state="NATION_3")


def _year(mart: Mart) -> Mart:
    return star.slice_mart(mart, year=1996)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and duplicates of the raw tables, written as CSV and read again by their schemas."""
    tables = raw_csv.read_raw(spark, generated.write_raw_files(spark, sf_dir))
    known = generated.raw_tables(spark, sf_dir)
    return quality.table_metrics({name: df.select(*known[name].columns) for name, df in tables.items()})


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = generated.write_raw_files(spark, sf_dir, damaged=True)
    return raw_csv.reject_counts(spark, folder, names=["orders", "order_items", "products"])


def _result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by state, stored as a CSV result and read again."""
    result = _plain(revenue.top_states(generated.open_mart(spark, sf_dir), 1000))
    target = star_store.write_result(result, stage_path(spark, "results"), "states")
    return spark.read.options(header=True).schema(result.schema).csv(target)


def _sql_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    star_store.register_views(generated.open_mart(spark, sf_dir))
    return spark.sql(
        """SELECT state, year, count(*) AS orders, CAST(sum(total_payment) AS DOUBLE) AS revenue
           FROM fact_orders JOIN dim_customer USING (customer_key) JOIN dim_date USING (date_key)
           GROUP BY state, year"""
    )


def _scaled_display(mart: Mart) -> DataFrame:
    """Measures per year as the pages show them: millions, thousands, points of five."""
    return measures.measure_totals(mart, ["year"]).select(
        "year",
        display.millions(F.col("total_revenue")).alias("revenue"),
        display.thousands(F.col("avg_order_value")).alias("order_value"),
        display.out_of_five(F.col("avg_review_score")).alias("review_score"),
    )


def _page(make: Callable[[Mart], dict], series: str) -> Query:
    """One series of a page of the dashboard, from the report cube."""
    return lambda spark, sf_dir: _plain(make(generated.open_cube(spark, sf_dir))[series]())


def _customer_page(series: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        mart, segments = _year(generated.open_cube(spark, sf_dir)), generated.open_segments(spark, sf_dir)
        return _plain(dashboard.customer_page(mart, segments, CHOSEN_SEGMENTS)[series]())

    return query


@cache
def _registry() -> dict[str, Query]:
    return {
        "table_row_counts": _on_raw(quality.row_counts),
        "star_row_counts": _on_mart(lambda m: quality.row_counts(m.tables())),
        "profile_nulls": _on_raw(quality.null_profile),
        "dq_null_counts": _on_raw(quality.null_counts),
        "dq_duplicate_rows": _on_raw(quality.duplicate_rows),
        "dq_issue_count": _on_raw(quality.issue_count),
        "clean_fill_defaults": _on_raw(_filled_defaults),
        "dedup_first_per_key": _on_raw(lambda raw: build.first_geo_per_zip(raw["geo"])),
        "dim_date": _on_raw(lambda raw: build.build_dim_date(raw["orders"])),
        "dim_customer": _on_raw(lambda raw: build.build_dim_customer(raw["customers"])),
        "dim_product": _on_clean(lambda t: build.build_dim_product(t["products"], t["category_xlat"])),
        "dim_seller": _on_raw(lambda raw: build.build_dim_seller(raw["sellers"])),
        "dim_geography": _dim_geography,
        "region_map": _regions,
        "order_payments_agg": _on_raw(lambda raw: build.payments_per_order(raw["payments"])),
        "order_review_agg": _on_raw(lambda raw: build.reviews_per_order(raw["reviews"])),
        "order_items_agg": _on_raw(lambda raw: build.items_per_order(raw["order_items"])),
        "fact_orders": _fact_orders,
        "delivery_days": _on_mart(lambda m: m.fact.select("order_id", "delivery_days", "is_late")),
        "price_bucket": _on_mart(lambda m: m.fact.select("order_id", "total_price", "price_bucket")),
        "fact_geography": _on_mart(star.fact_with_geography),
        "enriched_fact": _on_mart(star.enrich),
        "semi_join_active_dates": _on_mart(star.dates_with_sales),
        "daily_revenue": _on_mart(revenue.daily_revenue),
        "rolling_revenue": _on_mart(revenue.rolling_revenue),
        "peak_rolling_revenue": _on_mart(revenue.peak_rolling_revenue),
        "monthly_revenue": _on_mart(revenue.monthly_revenue),
        "monthly_aov": _on_mart(revenue.monthly_aov),
        "monthly_aov_mean": _on_mart(revenue.monthly_aov_mean),
        "top_categories": _on_mart(revenue.top_categories),
        "top_states": _on_mart(revenue.top_states),
        "leader_share": _on_mart(revenue.leader_share),
        "revenue_by_dow": _on_mart(revenue.revenue_by_dow),
        "revenue_by_price_bucket": _on_mart(revenue.revenue_by_price_bucket),
        "revenue_heatmap": _on_mart(revenue.revenue_heatmap),
        "delivery_by_state": _on_mart(delivery.delivery_by_state),
        "delivery_national_avg": _on_mart(delivery.delivery_national_avg),
        "ontime_vs_late": _on_mart(delivery.ontime_vs_late),
        "monthly_late_rate": _on_mart(delivery.monthly_late_rate),
        "monthly_late_rate_mean": _on_mart(delivery.monthly_late_rate_mean),
        "delivery_histogram": _on_mart(delivery.delivery_histogram),
        "delivery_histogram_lt60": _on_mart(delivery.delivery_histogram_lt60),
        "freight_pct_by_category": _on_mart(delivery.freight_pct_by_category),
        "repeat_buyers": _on_mart(customers.repeat_buyers),
        "repeat_order_histogram": _on_mart(customers.repeat_order_histogram),
        "review_distribution": _on_mart(customers.review_distribution),
        "five_star_pct": _on_mart(customers.five_star_pct),
        "payment_type_split": _on_mart(customers.payment_type_split),
        "order_status_breakdown": _on_mart(customers.order_status_breakdown),
        "customer_first_order": _on_mart(cohort.customer_first_order),
        "customer_month_orders": _on_mart(cohort.customer_month_orders),
        "cohort_size": _on_mart(cohort.cohort_size),
        "cohort_retention": _on_mart(cohort.cohort_retention),
        "avg_month1_retention": _on_mart(cohort.avg_month1_retention),
        "rfm_metrics": _on_mart(rfm.rfm_metrics),
        "rfm_scores": _on_mart(rfm.rfm_scores),
        "rfm_segments": _on_mart(rfm.rfm_segments),
        "rfm_segment_filter": _on_rfm(
            lambda r: star.membership(r, "segment", CHOSEN_SEGMENTS).select("customer_key", "segment")
        ),
        "rfm_segment_distribution": _on_rfm(rfm.segment_distribution),
        "rfm_segment_revenue": _on_rfm(rfm.segment_revenue),
        "rfm_top_customers": _on_rfm(rfm.top_customers),
        "customer_kpis": _on_rfm(rfm.customer_kpis),
        "headline_kpis": _on_mart(dashboard.headline_kpis),
        "kpi_vs_benchmark": _on_mart(dashboard.kpi_vs_benchmark),
        "dashboard_slice": _on_mart(
            lambda m: _slice(m).fact.select(
                "order_id", "date_key", "customer_key", "product_key", "order_status", "total_payment"
            )
        ),
        "dashboard_slice_kpis": _on_mart(lambda m: dashboard.headline_kpis(_slice(m))),
        "dashboard_slice_monthly_revenue": _on_mart(
            lambda m: revenue.monthly_revenue(star.slice_mart(m, category="unknown"))
        ),
        **{
            f"delivery_page_{series}": _page(lambda m: dashboard.delivery_page(_year(m)), series)
            for series in ("kpis", "delivery_by_state", "monthly_late_rate", "monthly_late_rate_mean", "delivery_histogram", "ontime_vs_late")
        },
        **{
            f"revenue_page_{series}": _page(lambda m: dashboard.revenue_page(_slice(m)), series)
            for series in ("kpis", "monthly_revenue", "top_categories", "revenue_by_price_bucket", "monthly_aov")
        },
        **{
            f"customer_page_{series}": _customer_page(series)
            for series in ("segment_revenue", "review_distribution", "payment_type_split", "top_customers")
        },
        "scaled_display": _on_mart(_scaled_display),
        "sql_over_views": _sql_over_views,
        "csv_round_trip": _csv_round_trip,
        "csv_rejects": _csv_rejects,
        "result_round_trip": _result_round_trip,
        "slicer_values": _on_mart(star.slicer_values),
        "share_of_total": _share_of_total,
        "measure_totals": _on_mart(measures.measure_totals),
        "measure_totals_by_month": _on_mart(lambda m: measures.measure_totals(m, ["year", "month"])),
        "measure_totals_by_category_year": _on_mart(lambda m: measures.measure_totals(m, ["category_en", "year"])),
        "measure_display": _on_mart(lambda m: display.format_measures(measures.measure_totals(m, ["year"]))),
        "late_rate_status": _on_mart(lambda m: measures.late_rate_status(m, ["year", "month"])),
        "revenue_yoy": _on_mart(measures.revenue_yoy),
        "revenue_yoy_by_year": _on_mart(lambda m: measures.revenue_yoy(m, "year")),
        "revenue_yoy_by_category_month": _on_mart(lambda m: measures.revenue_yoy(m, "month", ["category_en"])),
        "rolling_30d_calendar": _on_mart(measures.rolling_30d_calendar),
        "rolling_30d_by_state": _on_mart(lambda m: measures.rolling_30d_calendar(m, "day", ["state"])),
        "revenue_mtd": _on_mart(measures.revenue_mtd),
        "revenue_mtd_by_month": _on_mart(lambda m: measures.revenue_mtd(m, "month")),
        "revenue_mtd_by_category": _on_mart(lambda m: measures.revenue_mtd(m, "month", ["category_en"])),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Rolling revenue on the smallest tables."""
    return _registry()["rolling_revenue"](spark, FLAGSHIP_DIR)


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return {**_registry(), **TEXT_QUERIES}


def oracle_sql() -> dict[str, str]:
    """The statement for each registered query, over the generated tables."""
    return {name: STATEMENTS[name] for name in _registry() if name in STATEMENTS} | TEXT_STATEMENTS
