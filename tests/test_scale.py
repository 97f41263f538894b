"""What must hold for plans on large data, and results under heavy skew."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from datetime import date
from itertools import product
from pathlib import Path

import pytest
from compare import plan
from conftest import money
from pyspark.sql import functions as F

from bazaarlens.model import STAR_SCHEMAS
from bazaarlens.plans import build, cohort, cube, customers, rfm, star
from bazaarlens.sources import generated, star_store
from bazaarlens.workspace import shared_dir

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="generated tables are not here")


@needs_tables
def test_filters_and_columns_reach_the_scan(spark):
    mart = generated.open_mart(spark, SF_DIR)
    text = plan(star.totals(star.slice_mart(mart, year=1997), ["order_status"]).select("order_status", "payment_sum"))
    assert "GreaterThanOrEqual(date_key,19970000)" in text
    assert "ReadSchema: struct<date_key:int,order_status:string,total_payment:decimal(18,2)>" in text


def test_intermediate_tables_go_to_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_hot_customer_and_missing_keys(spark, make_mart):
    """A third of all orders by one customer, a third by nobody known."""
    n = 600
    facts = [
        {
            "customer_key": 1 if i % 3 == 0 else None if i % 3 == 1 else i,
            "product_key": 1 if i % 3 else None,
            "date_key": 20200101 + i % 28,
            "total_payment": i,
        }
        for i in range(n)
    ]
    people = [{"customer_key": k, "city": "x", "state": "SP" if k % 2 else "RJ"} for k in {1, *range(2, n, 3)}]
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 31), customers=people, products=[{"product_key": 1, "category_en": "a"}])
    known = [f for f in facts if f["customer_key"]]
    histogram = {r.order_count: r.customers for r in customers.repeat_order_histogram(mart).collect()}
    # Numbers that no customer has are bins, too.
    assert histogram == {count: int(count == n // 3) for count in range(2, n // 3 + 1)}
    states = {r.state: r.payment_sum for r in star.totals(mart, ["state"], keep_null_groups=True).collect()}
    expected = {"SP": 0, "RJ": 0, None: 0}
    for f in facts:
        k = f["customer_key"]
        expected[None if k is None else "SP" if k % 2 else "RJ"] += f["total_payment"]
    assert states == expected
    metrics = {r.customer_key: r for r in rfm.rfm_metrics(mart).collect()}
    assert len(metrics) == len({f["customer_key"] for f in known})
    assert metrics[1].frequency == n // 3
    cells = cohort.cohort_retention(mart).collect()
    assert [(r.active_customers, r.total_orders) for r in cells] == [(len(metrics), len(known))]
    assert star.enrich(mart).filter(F.col("category_en").isNull()).count() == n // 3


def test_skewed_lookups_are_split(spark, make_mart):
    """Joins that keep every row of the fact: the adaptive planner splits a hot or missing key."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    mart = make_mart([], date(2020, 1, 1), date(2020, 1, 1))
    n = F.col("id")
    fact = spark.range(0, 300_000, 1, 8).select(
        n.cast("string").alias("order_id"),
        F.lit(20200101).alias("date_key"),
        F.when(n % 3 == 0, 1).otherwise(n % 50_000).cast("bigint").alias("customer_key"),
        F.when(n % 3 != 1, n % 1000).cast("bigint").alias("product_key"),
    )
    people = spark.range(50_000).select(n.alias("customer_key"), F.lit("SP").alias("state"), F.lit("x").alias("city"))
    goods = spark.range(1000).select(n.alias("product_key"), F.lit("toys").alias("category_en"))
    wide = star.enrich(replace(mart, fact=fact, dim_customer=people, dim_product=goods))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        report = wide.groupBy("category_en", F.length("order_id").alias("digits"), "state").agg(
            F.count("*").alias("n"), F.max("order_id")
        )
        rows = report.collect()
        assert sum(r.n for r in rows if r.category_en is None) == 100_000
        assert sum(r.n for r in rows) == 300_000
        assert plan(report).count("skew=true") >= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_year_slice_opens_no_file_of_other_years(spark, make_mart, tmp_path):
    facts = [
        {"date_key": key, "customer_key": 1, "total_payment": n} for n, key in enumerate((20161231, 20170101, 20171231, 20180101, None))
    ]
    mart = make_mart(facts, date(2016, 12, 31), date(2018, 1, 1))
    star_store.write_star(mart, str(tmp_path))
    folders = sorted(path.name for path in (tmp_path / "fact_orders").iterdir() if path.is_dir())
    assert [name.partition("=")[2][:6] for name in folders] == ["2016", "2017", "2018", "__HIVE"]
    stored = star_store.read_star(spark, str(tmp_path))
    assert stored.fact.count() == 5 and "order_year" not in star.enrich(stored).columns
    for name in folders:
        for path in (tmp_path / "fact_orders" / name).glob("*.parquet"):
            if not name.endswith("2017"):
                path.write_bytes(b"no parquet")
    year = star.slice_mart(star_store.read_star(spark, str(tmp_path)), year=2017)
    assert sorted(row.total_payment for row in year.fact.collect()) == [1, 2]
    plan = year.fact._jdf.queryExecution().executedPlan().toString()
    assert "(order_year" in plan[plan.index("PartitionFilters") :].split("]")[0]


def test_a_star_read_back_is_stored_again_without_the_folder_column(spark, make_mart, tmp_path):
    mart = make_mart([{"date_key": 20170101, "customer_key": 1, "total_payment": 1}], date(2017, 1, 1), date(2017, 1, 2))
    star_store.write_star(mart, str(tmp_path / "a"))
    star_store.write_star(star_store.read_star(spark, str(tmp_path / "a")), str(tmp_path / "b"))
    again = star_store.read_star(spark, str(tmp_path / "b"))
    assert [row.asDict() for row in again.fact.collect()] == [row.asDict() for row in star_store.read_star(spark, str(tmp_path / "a")).fact.collect()]
    star_store.write_star(again, str(tmp_path / "c"), "csv")
    assert star_store.read_star(spark, str(tmp_path / "c"), "csv").fact.columns == STAR_SCHEMAS["fact_orders"].names


def test_lines_are_sent_once_and_grouped_where_they_arrive(spark):
    """Grouped inside the reading task, lines of scattered orders fill its memory and spill."""
    lines = spark.createDataFrame(
        [(i % 7, i % 3, f"p{i}", f"s{i}", money(i), money(1), "card" if i % 2 else None, 2, i % 5 + 1) for i in range(50)],
        "order_id int, order_item_id int, product_id string, seller_id string, price decimal(18,2), freight_value decimal(18,2),"
        " payment_type string, payment_installments int, review_score int",
    ).withColumn("payment_value", F.col("price"))
    for grouped in (build.items_per_order(lines), build.payments_per_order(lines), build.reviews_per_order(lines)):
        text = grouped._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in text and text.count("Exchange hashpartitioning") == 1
        # Printed from the result down to the scan: nothing is grouped below the exchange.
        assert "Aggregate" not in text[text.index("Exchange hashpartitioning") :]
    paid = {row.order_id: row for row in build.payments_per_order(lines).collect()}
    assert {k: (row.total_payment, row.payment_type) for k, row in paid.items()} == {k: (money(sum(range(k, 50, 7))), "card") for k in range(7)}


def test_the_most_frequent_payment_type_of_counted_rows(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (1, None), (2, "b"), (2, "b"), (2, "a"), (3, None), (None, "c")]
    payments = spark.createDataFrame([(k, t, 1, None) for k, t in rows], "order_id int, payment_type string, payment_installments int, payment_value decimal(18,2)")
    got = {row.order_id: (row.payment_type, row.total_payment) for row in build.payments_per_order(payments).collect()}
    assert got == {1: ("a", money(0)), 2: ("b", money(0)), 3: (None, money(0)), None: ("c", money(0))}


def test_a_customer_is_sent_once_for_all_slices(spark, make_mart, monkeypatch):
    monkeypatch.setattr(cube, "_ROWS_AT_ONCE", 2)
    facts = [{"date_key": 20170101 + i % 2 * 10_000, "customer_key": i % 5 or None, "product_key": 1} for i in range(23)]
    mart = make_mart(
        facts, date(2017, 1, 1), date(2018, 1, 2),
        customers=[{"customer_key": i, "state": "SP" if i % 2 else None} for i in range(1, 5)], products=[{"product_key": 1}],
    )
    wide = cube._with_attributes(mart)
    buyers = cube._buyers(cube._orders_per_customer(wide))
    text = buyers._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "Expand" not in cube._cells(wide)._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    known = [(f["date_key"] // 10_000, None, "SP" if f["customer_key"] % 2 else None, f["customer_key"]) for f in facts if f["customer_key"]]
    for pick in product((False, True), repeat=3):
        orders = Counter((*[None if at_all else v for at_all, v in zip(pick, key)], *pick, key[3]) for key in known)
        want.update((*key[:6], n) for key, n in orders.items())
    assert {tuple(row[:7]): row.customers for row in buyers.collect()} == dict(want)
