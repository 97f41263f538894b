from datetime import date

from conftest import moment
from pyspark.sql import functions as F

from bazaarlens.functions import dates, display, numbers
from bazaarlens.model import PRICE_EDGES, PRICE_LABELS


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(df, expression):
    return [row.y for row in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_price_buckets_are_closed_on_the_right(spark):
    df = column(spark, [None, -1.0, 0.0, 0.01, 50.0, 50.01, 150.0, 500.0, 500.01], "double")
    bucket = numbers.right_closed_bucket(F.col("x"), PRICE_EDGES, PRICE_LABELS)
    assert apply(df, bucket) == [
        None, None, None, "budget", "budget", "mid-range", "mid-range", "premium", "luxury",
    ]


def test_scores_round_half_to_even(spark):
    df = column(spark, [3.5, 4.5, 4.49, 1.5, 2.5, None], "double")
    assert apply(df, numbers.half_even_score(F.col("x"))) == [4, 4, 4, 2, 2, None]


def test_round2_goes_away_from_zero(spark):
    df = column(spark, [0.125, -0.125, 2.344, 2.346, 0.0, None], "double")
    assert apply(df, numbers.round2(F.col("x"))) == [0.13, -0.13, 2.34, 2.35, 0.0, None]


def test_division_without_quotient(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, None, 2.0), (2, 3.0, 2.0), (3, 1.0, None)], "i int, a double, b double")
    assert apply(df, numbers.ratio(F.col("a"), F.col("b"))) == [None, None, 1.5, None]
    assert apply(df, numbers.safe_divide(F.col("a"), F.col("b"))) == [0.0, 0.0, 1.5, 0.0]


def test_elapsed_days_count_whole_days_and_round_down(spark):
    pairs = [
        ("2020-01-01 23:00:00", "2020-01-02 01:00:00", 0),
        ("2020-01-01 00:00:00", "2020-01-02 00:00:00", 1),
        ("2020-01-02 00:00:00", "2020-01-01 23:59:59.999999", -1),
        ("2020-01-02 00:00:00", "2020-01-01 00:00:00", -1),
        ("2020-01-02 00:00:01", "2020-01-01 00:00:00", -2),
        # The night in which the session's time zone once moved its clock.
        ("2018-11-03 12:00:00", "2018-11-04 12:00:00", 1),
        ("2018-11-03 12:00:00", "2018-11-04 11:59:59", 0),
        ("1900-01-01 00:00:00", "2200-01-01 00:00:00", 109573),
    ]
    rows = [(i, moment(a), moment(b)) for i, (a, b, _) in enumerate(pairs)] + [(99, None, moment("2020-01-01 00:00:00"))]
    df = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz")
    assert apply(df, dates.elapsed_days(F.col("a"), F.col("b"))) == [days for *_, days in pairs] + [None]


def test_month_boundaries_are_counted(spark):
    df = spark.createDataFrame(
        [(0, date(2020, 1, 31), date(2020, 2, 1)), (1, date(2019, 12, 1), date(2021, 1, 1)), (2, date(2020, 5, 1), date(2020, 5, 31))],
        "i int, a date, b date",
    )
    assert apply(df, dates.months_between_starts(F.col("a"), F.col("b"))) == [1, 13, 0]


def test_labels(spark):
    df = spark.createDataFrame([(0, 2017, 3), (1, 2017, 11)], "i int, y int, m int")
    assert apply(df, dates.period_label(F.col("y"), F.col("m"))) == ["2017-03", "2017-11"]
    one = column(spark, [date(2018, 9, 3)], "date")
    assert apply(one, dates.date_key(F.col("x"))) == [20180903]
    names = column(spark, ["Sunday", "Monday", "x"], "string")
    assert apply(names, dates.position_in(F.col("x"), dates.WEEKDAYS)) == [7, 1, 0]


def test_late_rate_flags(spark):
    df = column(spark, [5.0, 5.01, 10.0, 10.01], "double")
    assert apply(df, numbers.late_status(F.col("x"))) == ["Good", "Watch", "Watch", "Critical"]
    rates = column(spark, [7.9, 7.91, None], "double")
    assert apply(rates, numbers.benchmark_side(F.col("x"))) == ["Below", "Above", "Below"]


def test_display(spark):
    df = spark.createDataFrame([(1234567.891, 1200, 7.86)], "total_revenue double, total_orders long, late_order_rate_pct double")
    assert display.format_measures(df).first().asDict() == {
        "total_revenue": "R$1,234,567.89",
        "total_orders": "1,200",
        "late_order_rate_pct": "7.9%",
    }


def test_scaled_amounts(spark):
    from bazaarlens.functions import display

    row = spark.range(1).select(
        display.millions(F.lit(13591643.7)), display.thousands(F.lit(1234.5)), display.out_of_five(F.lit(4.086))
    ).first()
    assert tuple(row) == ("R$13.59M", "R$1.2K", "4.09 / 5")
