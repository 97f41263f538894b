import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens.plans import cohort, cube, customers, dashboard, delivery, measures, revenue, rfm, star


def key(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def test_row_frames_and_calendar_frames_differ_over_gaps(make_mart):
    first = date(2020, 1, 1)
    sold = [first + timedelta(days=d) for d in (0, 1, 40, 41, 80)]
    facts = [{"date_key": key(d), "total_payment": 10 * (i + 1)} for i, d in enumerate(sold)]
    facts.append({"date_key": key(sold[0]), "total_payment": 1000, "order_status": "canceled"})
    mart = make_mart(facts, first, first + timedelta(days=80))
    rolling = revenue.rolling_revenue(mart).collect()
    assert [r.order_date for r in rolling] == sold
    assert [r.rolling_30d_revenue for r in rolling] == [10, 30, 60, 100, 150]
    assert [r.cumulative_revenue for r in rolling] == [10, 30, 60, 100, 150]
    assert [r.dod_change_pct for r in rolling] == [None, 100.0, 50.0, 33.33, 25.0]
    calendar = {r.full_date: r.rolling_30d_revenue for r in measures.rolling_30d_calendar(mart).collect()}
    assert len(calendar) == 81
    assert calendar[sold[0]] == 1010
    assert calendar[first + timedelta(days=29)] == 1030
    assert calendar[first + timedelta(days=30)] == 20
    assert calendar[first + timedelta(days=35)] is None
    assert calendar[sold[2]] == 30
    mtd = {r.full_date: r.revenue_mtd for r in measures.revenue_mtd(mart).collect()}
    assert (mtd[date(2020, 1, 31)], mtd[date(2020, 2, 1)], mtd[sold[3]]) == (1030, None, 70)
    by_month = measures.revenue_mtd(mart, "month").collect()
    assert [(r.month, r.revenue_mtd) for r in by_month] == [(1, 1030), (2, 70), (3, 50)]
    assert [r.rolling_30d_revenue for r in measures.rolling_30d_calendar(mart, "month").collect()] == [20, 70, 50]


def test_change_to_a_day_without_revenue_is_unknown(make_mart):
    first = date(2020, 1, 1)
    facts = [{"date_key": 20200101, "total_payment": 0}, {"date_key": 20200102, "total_payment": 5}]
    rows = revenue.rolling_revenue(make_mart(facts, first, date(2020, 1, 2))).collect()
    assert [r.dod_change_pct for r in rows] == [None, None]


def test_year_over_year_compares_the_same_days(make_mart):
    facts = [
        {"date_key": 20160228, "total_payment": 100},
        {"date_key": 20160229, "total_payment": 20},
        {"date_key": 20160305, "total_payment": 50},
        {"date_key": 20160320, "total_payment": 900},
        {"date_key": 20170228, "total_payment": 240},
        {"date_key": 20170301, "total_payment": 75},
    ]
    mart = make_mart(facts, date(2016, 2, 28), date(2017, 3, 10))
    months = {(r.year, r.month): r for r in measures.revenue_yoy(mart).collect()}
    # 29 February counts with the 28th; March 2017 has only ten days, so the 20th has no partner.
    assert months[2017, 2].revenue_yoy_pct == 100.0
    assert (months[2017, 3].prior_revenue, months[2017, 3].revenue_yoy_pct) == (50, 50.0)
    assert months[2016, 2].revenue_yoy_pct == 0.0
    days = {r.full_date: r for r in measures.revenue_yoy(mart, "day").collect()}
    assert days[date(2017, 2, 28)].prior_revenue == 120
    assert days[date(2017, 3, 5)].revenue_yoy_pct == -100.0


def test_time_measures_by_an_attribute(make_mart):
    products = [{"product_key": 1, "category_en": "toys"}, {"product_key": 2, "category_en": None}]
    facts = [
        {"date_key": 20200110, "product_key": 1, "total_payment": 10},
        {"date_key": 20200120, "product_key": 1, "total_payment": 5},
        {"date_key": 20200120, "product_key": 2, "total_payment": 7},
        {"date_key": 20200121, "product_key": None, "total_payment": 1},
        {"date_key": 20200122, "product_key": 2, "total_payment": None},
        {"date_key": 20210115, "product_key": 1, "total_payment": 40},
    ]
    mart = make_mart(facts, date(2020, 1, 10), date(2021, 1, 20), products=products)
    by = ["category_en"]
    yoy = {(r.category_en, r.year): r for r in measures.revenue_yoy(mart, "month", by).collect()}
    assert set(yoy) == {("toys", 2020), (None, 2020), ("toys", 2021), (None, 2021)}
    assert (yoy["toys", 2021].revenue, yoy["toys", 2021].prior_revenue) == (40, 15)
    # 21 January 2021 is beyond the calendar, so its partner of the year before does not count.
    assert (yoy[None, 2021].revenue, yoy[None, 2021].prior_revenue, yoy[None, 2021].revenue_yoy_pct) == (None, 7, -100.0)
    rolling = {(r.category_en, r.full_date): r.rolling_30d_revenue for r in measures.rolling_30d_calendar(mart, "day", by).collect()}
    assert (rolling["toys", date(2020, 2, 8)], rolling["toys", date(2020, 2, 9)]) == (15, 5)
    assert (rolling[None, date(2020, 1, 20)], rolling[None, date(2020, 1, 21)]) == (7, 8)
    assert ("toys", date(2020, 2, 19)) not in rolling and max(d for _, d in rolling) == date(2021, 1, 20)
    mtd = {(r.category_en, r.last_date): r.revenue_mtd for r in measures.revenue_mtd(mart, "month", by).collect()}
    assert mtd == {("toys", date(2020, 1, 31)): 15, (None, date(2020, 1, 31)): 8, ("toys", date(2021, 1, 20)): 40}


def test_measures_divide_by_all_orders(make_mart):
    facts = [
        {"date_key": 20200101, "total_payment": 10, "is_late": 1, "avg_review_score": 4.0},
        {"date_key": 20200101, "total_payment": None, "is_late": 0},
        {"date_key": 20200102, "total_payment": 20, "is_late": 0, "delivery_days": 3},
    ]
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 2))
    row = measures.measure_totals(mart).first()
    assert (row.total_orders, row.avg_order_value) == (3, 10.0)
    assert row.late_order_rate_pct == pytest.approx(100 / 3)
    assert (row.avg_delivery_days, row.avg_review_score) == (3.0, 4.0)
    assert dashboard.headline_kpis(mart).first().avg_order_value == 15.0
    assert measures.late_rate_status(mart).first().late_rate_status == "Critical"
    nothing = mart.with_fact(mart.fact.limit(0))
    empty = measures.measure_totals(nothing).first()
    assert (empty.total_revenue, empty.total_orders, empty.avg_order_value) == (None, 0, 0.0)


def test_pandas_style_groups_drop_nulls_and_sum_nothing_to_zero(make_mart):
    facts = [
        {"date_key": 20200101, "total_payment": None, "payment_type": "card"},
        {"date_key": 20200101, "total_payment": 4, "payment_type": None},
    ]
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 1))
    rows = customers.payment_type_split(mart).collect()
    assert [(r.payment_type, r.orders, r.revenue) for r in rows] == [("card", 1, 0)]


def test_weekdays_without_sales_stay(make_mart):
    mart = make_mart([{"date_key": 20200106, "total_payment": 4}], date(2020, 1, 6), date(2020, 1, 6))
    rows = revenue.revenue_by_dow(mart).collect()
    assert [(r.day_of_week[:3], r.revenue) for r in rows] == [
        ("Mon", 4), ("Tue", None), ("Wed", None), ("Thu", None), ("Fri", None), ("Sat", None), ("Sun", None),
    ]
    heat = revenue.revenue_heatmap(mart).collect()
    assert [(r.month_name, r.monday, r.sunday) for r in heat] == [("January", 4, 0)]


def test_cohorts(make_mart):
    facts = [
        {"customer_key": 1, "date_key": 20200131, "total_payment": 1},
        {"customer_key": 1, "date_key": 20200201, "total_payment": 2},
        {"customer_key": 1, "date_key": 20200215, "total_payment": 4},
        {"customer_key": 2, "date_key": 20200105, "total_payment": 8},
        {"customer_key": 3, "date_key": 20200203, "total_payment": 16},
        {"customer_key": None, "date_key": 20200101, "total_payment": 99},
    ]
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 2, 28))
    rows = [tuple(r) for r in cohort.cohort_retention(mart).collect()]
    jan, feb = date(2020, 1, 1), date(2020, 2, 1)
    assert rows == [
        (jan, 2, jan, 0, 2, 100.0, 2, 9),
        (jan, 2, feb, 1, 1, 50.0, 2, 6),
        (feb, 1, feb, 0, 1, 100.0, 1, 16),
    ]
    assert cohort.avg_month1_retention(mart).first()[0] == 50.0
    assert {tuple(r) for r in cohort.cohort_size(mart).collect()} == {(jan, 2), (feb, 1)}


def test_nobody_comes_back(make_mart):
    facts = [{"customer_key": i, "date_key": 20200101, "total_payment": 1} for i in range(3)]
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 1))
    assert customers.repeat_order_histogram(mart).collect() == []
    assert [(r.buyer_type, r.customers) for r in customers.repeat_buyers(mart).collect()] == [("One-time", 3)]
    assert cohort.avg_month1_retention(mart).collect() == []


def test_people_instead_of_customer_records(make_mart):
    records = [
        {"customer_key": 1, "customer_unique_id": "ann", "state": "SP"},
        {"customer_key": 2, "customer_unique_id": "bob", "state": "RJ"},
        {"customer_key": 3, "customer_unique_id": "ann", "state": "SP"},
    ]
    facts = [{"customer_key": k, "date_key": 20200101, "total_payment": 1} for k in (1, 2, 3, None)]
    mart = star.rekey_customers(make_mart(facts, date(2020, 1, 1), date(2020, 1, 1), customers=records))
    assert {(r.buyer_type, r.customers) for r in customers.repeat_buyers(mart).collect()} == {("One-time", 1), ("Repeat", 1)}
    assert mart.fact.count() == 4


def segment_by_hand(r, f, m):
    rules = [
        (r == f == m == 4, "Champions"),
        (min(r, f) >= 3, "Loyal Customers"),
        (r == 4, "Recent Customers"),
        (r == 3 and m >= 3, "Potential Loyalists"),
        (r == 1 and f >= 3, "At Risk"),
        (r <= 2 and f <= 2, "Hibernating"),
    ]
    return next((name for holds, name in rules if holds), "Need Attention")


def test_all_score_triples(spark):
    triples = [(r, f, m) for r in range(1, 5) for f in range(1, 5) for m in range(1, 5)]
    df = spark.createDataFrame(triples, "r int, f int, m int")
    rows = df.withColumn("s", rfm.segment_of(F.col("r"), F.col("f"), F.col("m"))).collect()
    assert {(x.r, x.f, x.m): x.s for x in rows} == {t: segment_by_hand(*t) for t in triples}
    assert len({x.s for x in rows}) == 7
    potential = [x for x in rows if x.s == "Potential Loyalists"]
    assert {x.r for x in potential} == {3}


def test_segmentation(make_mart):
    people = [{"customer_key": i, "city": f"c{i}", "state": "SP"} for i in range(1, 5)]
    facts = [
        {"customer_key": i, "date_key": 20200100 + i, "total_payment": 10 * i, "avg_review_score": 4.0}
        for i in range(1, 5)
    ]
    # A customer nobody knows has the last order: it moves the snapshot date and nothing else.
    facts.append({"customer_key": 77, "date_key": 20200110, "total_payment": 1})
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 31), customers=people)
    rows = rfm.rfm_segments(mart).collect()
    assert [r.customer_key for r in rows] == [4, 3, 2, 1]
    assert [r.recency_days for r in rows] == [6, 7, 8, 9]
    assert [(r.rfm_score, r.segment) for r in rows] == [
        ("444", "Champions"), ("333", "Loyal Customers"), ("222", "Hibernating"), ("111", "Hibernating"),
    ]
    result = rfm.rfm_segments(mart)
    assert [r.monetary for r in rfm.top_customers(result, 2).collect()] == ["R$40.00", "R$30.00"]
    assert rfm.segment_distribution(result, ["Champions"]).count() == 1
    assert rfm.segment_distribution(result, []).count() == 3
    assert rfm.customer_kpis(result).first().champions_pct == 25.0


def test_reference_lines_of_delivery_differ(make_mart):
    people = [{"customer_key": 1, "state": "SP"}, {"customer_key": 2, "state": "AM"}]
    facts = [{"customer_key": 1, "date_key": 20200101, "delivery_days": 2} for _ in range(3)]
    facts.append({"customer_key": 2, "date_key": 20200101, "delivery_days": 10})
    facts.append({"customer_key": None, "date_key": 20200101, "delivery_days": 4})
    mart = make_mart(facts, date(2020, 1, 1), date(2020, 1, 1), customers=people)
    row = delivery.delivery_national_avg(mart).first()
    assert (row.mean_of_orders, row.mean_of_state_means) == (4.0, 6.0)
    states = delivery.delivery_by_state(mart).collect()
    assert [(r.state, r.above_mean) for r in states] == [("AM", True), ("SP", False)]


def test_slices(make_mart):
    people = [{"customer_key": 1, "state": "SP"}, {"customer_key": 2, "state": "RJ"}]
    goods = [{"product_key": 1, "category_en": "toys"}, {"product_key": 2, "category_en": "auto"}]
    facts = [
        {"customer_key": c, "product_key": p, "date_key": d, "total_payment": 1}
        for c in (1, 2, None)
        for p in (1, 2, None)
        for d in (20191231, 20200101)
    ]
    mart = make_mart(facts, date(2019, 12, 31), date(2020, 1, 1), customers=people, products=goods)
    count = lambda **chosen: star.slice_mart(mart, **chosen).fact.count()
    assert count() == 18
    assert count(year=2020) == count(year="2020") == 9
    assert count(state="SP") == 6
    assert count(category="toys", state="RJ", year=2019) == 1
    values = [(r.slicer, r.value) for r in star.slicer_values(mart).collect()]
    assert values == [
        ("category_en", "auto"), ("category_en", "toys"), ("state", "RJ"), ("state", "SP"), ("year", "2019"), ("year", "2020"),
    ]
    pages = [*dashboard.revenue_page(mart).values(), *dashboard.delivery_page(mart).values()]
    assert all(make().columns for make in pages)


def test_the_cube_gives_what_the_fact_gives(spark, make_mart):
    draw = random.Random(8)
    facts = [
        {
            "date_key": draw.choice([20170101, 20170215, 20180103, 20180228, None]),
            "customer_key": draw.choice([1, 2, 3, 4, None, 9]), "product_key": draw.choice([1, 2, None, 7]),
            "total_payment": draw.choice([None, 5, 10.25]), "total_price": draw.choice([None, 4]), "is_late": draw.choice([0, 1]),
            "order_status": draw.choice(["delivered", "shipped"]), "payment_type": draw.choice([None, "card"]),
            "delivery_days": draw.choice([None, -1, 3, 70]), "avg_review_score": draw.choice([None, 2.5, 3.5, 5.0]),
            "price_bucket": draw.choice(["budget", None]),
        }
        for _ in range(200)
    ]
    mart = make_mart(
        facts, date(2017, 1, 1), date(2018, 3, 1),
        customers=[{"customer_key": i, "state": s} for i, s in enumerate(["SP", "SP", None, "RJ"], 1)],
        products=[{"product_key": 1, "category_en": "toys"}, {"product_key": 2, "category_en": None}],
    )
    whole = cube.with_cube(mart)
    series = [
        dashboard.headline_kpis, customers.repeat_buyers, customers.repeat_order_histogram, customers.review_distribution,
        delivery.delivery_histogram_lt60, revenue.revenue_heatmap, revenue.monthly_aov, measures.revenue_mtd, star.slicer_values,
        measures.rolling_30d_calendar, lambda m: measures.measure_totals(m, ["state", "day_of_week"]),
    ]
    for choice in ({}, {"year": 2018}, {"year": "2017", "state": "SP"}, {"category": "toys", "state": "RJ"}, {"state": "XX"}):
        for make in series:
            want, got = make(star.slice_mart(mart, **choice)), make(star.slice_mart(whole, **choice))
            assert got.columns == want.columns
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] or sorted(
                map(tuple, got.collect()), key=str
            ) == sorted(map(tuple, want.collect()), key=str)
            assert "order_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_running_sum_has_two_rows_per_day_of_a_group(spark, make_mart):
    facts = [{"date_key": 20170101 + i % 28, "customer_key": 1, "total_payment": 1} for i in range(200)]
    mart = make_mart(facts, date(2017, 1, 1), date(2017, 3, 1), customers=[{"customer_key": 1, "state": "SP"}])
    rows = measures.rolling_30d_calendar(mart, "month", ["state"]).collect()
    # The window of 31 January begins on the 2nd; nothing of January counts on the last day of February.
    in_window = sum(i % 28 >= 1 for i in range(200))
    assert [(r["state"], r["month"], int(r["rolling_30d_revenue"])) for r in rows] == [("SP", 1, in_window)]
