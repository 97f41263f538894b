from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bazaarlens.jobs import build_star, profile_raw, run_queries, run_reports
from bazaarlens.model import STAR_SCHEMAS
from bazaarlens.plans import build
from bazaarlens.sources import raw_csv, star_store

# A small shop. Files hold columns in another order than the schema, and some more.
FILES = {
    "shop_orders_dataset.csv": """\
"order_id","customer_id","order_status","order_purchase_timestamp","order_approved_at","order_delivered_carrier_date","order_delivered_customer_date","order_estimated_delivery_date"
"o1","c1","delivered","2017-12-30 23:00:00","2017-12-30 23:10:00","2017-12-31 09:00:00","2018-01-01 01:00:00","2018-01-05 00:00:00"
"o2","c2","delivered","2018-01-01 10:00:00","","2018-01-02 10:00:00","2018-01-20 10:00:00","2018-01-10 00:00:00"
"o3","c3","shipped","2018-01-02 00:00:00","2018-01-02 00:00:00","","","2018-01-09 00:00:00"
"o4","c9","canceled","2018-01-03 08:30:00","","","","2018-01-20 00:00:00"
""",
    "shop_order_items_dataset.csv": """\
"order_id","order_item_id","product_id","seller_id","shipping_limit_date","price","freight_value"
"o1",2,"p2","s2","2018-01-01 00:00:00",30.00,5.00
"o1",1,"p1","s1","2018-01-01 00:00:00",20.00,2.50
"o2",1,"p3","s9","2018-01-01 00:00:00",150.01,10.00
"o3",1,"p1","s1","2018-01-01 00:00:00",0.00,1.00
""",
    "shop_products_dataset.csv": """\
"product_id","product_category_name","product_name_lenght","product_description_lenght","product_photos_qty","product_weight_g","product_length_cm","product_height_cm","product_width_cm"
"p2","brinquedos",40,287,1,225,16,10,14
"p1","sem_traducao",44,276,1,1000,30,18,20
"p3",,,,,,,,
""",
    "shop_customers_dataset.csv": """\
"customer_id","customer_unique_id","customer_zip_code_prefix","customer_city","customer_state"
"c2","u1",01002,"sao paulo","SP"
"c1","u1",01001,"sao paulo","SP"
"c3","u2",99999,"manaus","AM"
""",
    "shop_sellers_dataset.csv": """\
"seller_id","seller_zip_code_prefix","seller_city","seller_state"
"s2",13023,"campinas","SP"
"s1",01001,"sao paulo","SP"
""",
    "shop_order_payments_dataset.csv": """\
"order_id","payment_sequential","payment_type","payment_installments","payment_value"
"o1",1,"voucher",1,10.00
"o1",2,"credit_card",3,47.50
"o2",1,"boleto",1,100.00
"o2",2,"credit_card",2,30.01
"o2",3,"boleto",1,30.00
""",
    "shop_order_reviews_dataset.csv": """\
"review_id","order_id","review_score","review_comment_title","review_comment_message","review_creation_date","review_answer_timestamp"
"r1","o1",5,"","line one
line ""two"", end","2018-01-01 00:00:00","2018-01-01 00:00:00"
"r2","o1",4,"bom",,"2018-01-01 00:00:00","2018-01-01 00:00:00"
"r3","o3",1,"NA","x","2018-01-01 00:00:00","2018-01-01 00:00:00"
""",
    "shop_geolocation_dataset.csv": """\
"geolocation_zip_code_prefix","geolocation_lat","geolocation_lng","geolocation_city","geolocation_state"
01002,-23.5,-46.6,"sao paulo","SP"
01001,-23.9,-46.1,"sao paulo","SP"
01001,-23.1,-46.9,"são paulo","SP"
01002,-23.5,-46.6,"sao paulo","SP"
70000,-15.7,-47.8,"brasilia","XX"
""",
    "product_category_name_translation.csv": "﻿product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def star_dir(spark, raw_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    build_star.run(spark, raw_dir, folder)
    return folder


@pytest.fixture(scope="module")
def mart(spark, star_dir):
    return star_store.read_star(spark, star_dir)


def by(df, name):
    return {row[name]: row for row in df.collect()}


def test_text_columns_survive(spark, raw_dir):
    reviews = by(raw_csv.read_raw(spark, raw_dir)["reviews"], "review_id")
    assert reviews["r1"].review_comment_message == 'line one\nline "two", end'
    assert reviews["r1"].review_comment_title is None
    assert reviews["r3"].review_comment_title is None
    assert reviews["r2"].review_score == 4


def test_header_names_decide_and_byte_order_mark_is_gone(spark, raw_dir):
    raw = raw_csv.read_raw(spark, raw_dir)
    assert raw["category_xlat"].columns[0] == "product_category_name"
    assert raw["order_items"].filter("order_item_id = 2").first().price == Decimal("30.00")


def test_missing_columns_and_files_are_named(spark, raw_dir, tmp_path):
    (tmp_path / "x_orders_dataset.csv").write_text("order_id\no1\n")
    with pytest.raises(ValueError, match="customer_id"):
        raw_csv.read_raw(spark, str(tmp_path))
    assert set(raw_csv.missing_files(spark, str(tmp_path))) == set(raw_csv.RAW_FILES) - {"orders"}
    absent, report, rejected = profile_raw.profile(spark, raw_dir)
    nulls = {(r.table_name, r.column_name): r.null_count for r in report.collect()}
    assert absent == [] and rejected.collect() == []
    assert nulls["orders", "order_delivered_customer_date"] == 2
    assert nulls["products", "product_category_name"] == 1
    assert nulls["customers", "customer_id"] == 0


def test_a_profile_goes_on_without_a_file(spark, raw_dir, tmp_path):
    for file in Path(raw_dir).iterdir():
        if "sellers" not in file.name:
            (tmp_path / file.name).write_bytes(file.read_bytes())
    absent, report, _ = profile_raw.profile(spark, str(tmp_path))
    assert absent == ["sellers"]
    assert {r.table_name for r in report.collect()} == set(raw_csv.RAW_FILES) - {"sellers"}
    assert profile_raw.profile(spark, str(tmp_path / "nothing"))[1] is None


def test_quality_issues(spark, raw_dir):
    # Nulls in orders, products and reviews; one repeated row in geo.
    assert build_star.log_quality(raw_csv.read_raw(spark, raw_dir)) == 4


def test_dimensions_are_numbered_in_file_order(mart):
    assert {r.customer_id: r.customer_key for r in mart.dim_customer.collect()} == {"c2": 1, "c1": 2, "c3": 3}
    products = by(mart.dim_product, "product_id")
    assert {p: (r.product_key, r.category_en) for p, r in products.items()} == {
        "p2": (1, "toys"),
        "p1": (2, "sem_traducao"),
        "p3": (3, "unknown"),
    }
    assert {r.seller_id: r.seller_key for r in mart.dim_seller.collect()} == {"s2": 1, "s1": 2}


def test_geography_keeps_the_first_row_of_a_zip_code(mart):
    places = by(mart.dim_geography, "zip_code")
    assert {z: (r.lat, r.region) for z, r in places.items()} == {
        1001: (-23.9, "Southeast"),
        1002: (-23.5, "Southeast"),
        70000: (-15.7, "Other"),
    }
    assert sorted(r.geo_key for r in places.values()) == [1, 2, 3]


def test_calendar(mart):
    days = [tuple(r) for r in mart.dim_date.orderBy("full_date").collect()]
    assert days[0] == (date(2017, 12, 30), 20171230, 2017, 4, 12, "December", 52, "Saturday", True)
    assert days[2] == (date(2018, 1, 1), 20180101, 2018, 1, 1, "January", 1, "Monday", False)
    assert len(days) == 5


def test_fact_has_one_row_per_order(mart):
    fact = by(mart.fact, "order_id")
    assert len(fact) == 4
    assert mart.fact.columns == STAR_SCHEMAS["fact_orders"].names
    o1, o2, o3, o4 = (fact[f"o{i}"] for i in range(1, 5))
    # First in the file, not least item number.
    assert (o1.product_key, o1.seller_key, o1.qty) == (1, 1, 2)
    assert (o1.total_price, o1.total_freight, o1.total_payment) == (Decimal("50.00"), Decimal("7.50"), Decimal("57.50"))
    assert (o1.payment_type, o1.num_installments) == ("credit_card", 3)
    assert (o1.delivery_days, o1.is_late, o1.avg_review_score, o1.price_bucket) == (1, 0, 4.5, "budget")
    assert (o2.payment_type, o2.is_late, o2.price_bucket, o2.seller_key) == ("boleto", 1, "premium", None)
    assert (o2.geo_key is not None, o3.geo_key) == (True, None)
    # Delivered, so to say, on the promised day.
    assert (o3.delivery_days, o3.is_late, o3.price_bucket) == (7, 0, None)
    assert (o4.customer_key, o4.total_payment, o4.qty, o4.delivery_days) == (None, None, None, 16)
    assert o1.date_key == 20171230


def test_star_survives_csv(spark, mart, tmp_path):
    star_store.write_star(mart, str(tmp_path), "csv")
    again = star_store.read_star(spark, str(tmp_path), "csv")
    for name, df in mart.tables().items():
        other = again.tables()[name]
        assert other.schema.simpleString() == df.schema.simpleString()
        assert other.exceptAll(df).count() == 0 and df.exceptAll(other).count() == 0


def test_whole_numbers_written_as_fractions_are_read(spark, mart, tmp_path):
    star_store.write_star(mart.with_fact(mart.fact.withColumn("qty", F.col("qty").cast("double"))), str(tmp_path), "csv")
    assert star_store.read_star(spark, str(tmp_path), "csv").fact.agg(F.sum("qty")).first()[0] == 4


def test_views(spark, mart):
    star_store.register_views(mart)
    found = spark.sql("SELECT count(*) AS n FROM fact_orders JOIN dim_date USING (date_key)").first().n
    assert found == 4


def test_query_job_stores_three_results(spark, mart, tmp_path):
    summary = run_queries.run(mart, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {
        "result_01_rolling_revenue.csv", "result_02_cohort.csv", "result_03_rfm.csv",
    }
    assert "rolling revenue: 2 days, peak of 30 days R$217.51" in summary
    rfm = spark.read.option("header", True).csv(str(tmp_path / "result_03_rfm.csv"))
    assert rfm.count() == 3 and rfm.columns[0] == "customer_key"


def test_report_job_stores_every_series(spark, mart, tmp_path):
    stored = run_reports.run(mart, str(tmp_path), year=2018, state="SP")
    assert len(stored) == len(set(stored)) > 30
    months = spark.read.option("header", True).csv(str(tmp_path / "result_revenue_monthly_revenue.csv"))
    assert [(r.period, r.revenue) for r in months.collect()] == [("2018-01", "160.01")]


def test_fills(spark):
    orders = spark.createDataFrame(
        [(None, datetime(2020, 1, 2)), (datetime(2020, 1, 1), datetime(2020, 1, 2))],
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    filled = [r.order_delivered_customer_date.day for r in build.fill_delivery_date(orders).collect()]
    assert sorted(filled) == [1, 2]


def test_repeated_keys_are_numbered_the_same_way_every_time(spark):
    rows = [("c2", "u9", 1, "x", "SP"), ("c1", "u3", 1, "x", "SP"), ("c1", "u2", 1, "x", "SP"), ("c1", "u2", 1, "x", "SP")]
    schema = "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string"
    numbered = build.build_dim_customer(spark.createDataFrame(rows, schema).repartition(3))
    assert [(r.customer_key, r.customer_id, r.customer_unique_id) for r in numbered.orderBy("customer_key").collect()] == [
        (1, "c1", "u2"), (2, "c1", "u2"), (3, "c1", "u3"), (4, "c2", "u9"),
    ]
