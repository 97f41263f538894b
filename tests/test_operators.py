import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.model import SOURCE_ORDER
from bazaarlens.operators import distribution, grouping, quality
from bazaarlens.operators.ranking import dense_index, file_index, rows_at, tile_starts, top_k, with_tiles
from bazaarlens.sources import raw_csv


def test_dense_index_with_one_value_in_a_third_of_the_rows(spark):
    random.seed(1)
    values = [7] * 1000 + [random.randrange(50) for _ in range(1900)] + [None] * 100
    random.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    rows = dense_index(df, [F.col("v").asc_nulls_last(), F.col("id")], "n").collect()
    expected = sorted(enumerate(values), key=lambda p: (p[1] is None, p[1] or 0, p[0]))
    assert [(r.id, r.v) for r in sorted(rows, key=lambda r: r.n)] == expected
    assert sorted(r.n for r in rows) == list(range(1, 3001))


def test_dense_index_of_nothing(spark):
    df = spark.createDataFrame([], "id int")
    assert dense_index(df, [F.col("id")], "n").collect() == []


@pytest.mark.parametrize("whole", [True, False])
def test_rows_are_numbered_in_file_order_without_a_sort(spark, tmp_path, whole):
    for name, first, last in (("a", 0, 700), ("b", 700, 701), ("c", 701, 1500)):
        (tmp_path / f"{name}.csv").write_text("id\n" + "".join(f"id{k:05d}\n" for k in range(first, last)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        schema = T.StructType([T.StructField("id", T.StringType())])
        df = raw_csv.read_csv(spark, str(tmp_path), schema)
        kept = [k for k in range(1500) if whole or k % 3]
        if not whole:
            df = df.filter(F.col("id").isin([f"id{k:05d}" for k in kept])).repartition(5)
        numbered = file_index(df, SOURCE_ORDER, "n", whole)
        rows = numbered.select("id", "n").collect()
        blocks = df.select(f"{SOURCE_ORDER}.file", f"{SOURCE_ORDER}.block").distinct().count()
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert file_index(df.limit(0), SOURCE_ORDER, "n", whole).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10 and "rangepartitioning" not in plan
    assert sorted((r.n, r.id) for r in rows) == [(n, f"id{k:05d}") for n, k in enumerate(kept, 1)]


def tiles_by_hand(values, k):
    """The rule itself: the first n % k tiles hold one row more."""
    n = len(values)
    size, rest = divmod(n, k)
    sizes = [size + (tile < rest) for tile in range(k)]
    numbers = [tile + 1 for tile, s in enumerate(sizes) for _ in range(s)]
    order = sorted(range(n), key=lambda i: (values[i] is None, values[i] or 0, i))
    return {i: t for i, t in zip(order, numbers)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 9])
def test_tile_remainders(n):
    starts = tile_starts(n, 4)
    tiles = [1 + sum(i >= s for s in starts) for i in range(1, n + 1)]
    assert tiles == [t for _, t in sorted(tiles_by_hand(list(range(n)), 4).items())]


def test_tiles_of_several_measures_with_ties_and_nulls(spark):
    random.seed(2)
    a = [1] * 40 + [random.randrange(5) for _ in range(59)]
    b = [None if random.random() < 0.2 else random.randrange(1000) for _ in range(99)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "id long, a int, b int")
    rows = with_tiles(df, {"ta": F.col("a"), "tb": F.col("b"), "tc": -F.col("a")}, "id", 4).collect()
    assert {r.id: r.ta for r in rows} == tiles_by_hand(a, 4)
    assert {r.id: r.tb for r in rows} == tiles_by_hand(b, 4)
    assert {r.id: r.tc for r in rows} == tiles_by_hand([-x for x in a], 4)


def test_tiles_match_the_built_in_window(spark):
    df = spark.range(1003).select("id", (F.pmod(F.hash("id"), F.lit(37))).alias("v"))
    ours = with_tiles(df, {"t": F.col("v")}, "id", 7)
    theirs = df.selectExpr("id", "ntile(7) over (order by v, id) as w")
    assert ours.join(theirs, "id").filter("t <> w").count() == 0


def test_top_k_breaks_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "k string, v int")
    assert [r.k for r in top_k(df, 2, F.desc("v"), F.asc("k")).collect()] == ["c", "a"]


def test_most_common_and_first_present(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "boleto", None), (1, 2, "card", "p2"), (1, 3, None, "p3"),
            (2, 2, "card", "q2"), (2, 1, "card", "q1"), (2, 3, "boleto", "q3"),
            (3, 1, None, None),
        ],
        "order_id int, item int, kind string, product string",
    )
    rows = df.groupBy("order_id").agg(
        grouping.most_common("kind").alias("kind"), grouping.first_present("product", ["item"]).alias("first")
    )
    assert {r.order_id: (r.kind, r.first) for r in rows.collect()} == {
        1: ("boleto", "p2"),
        2: ("card", "q1"),
        3: (None, None),
    }


def test_first_row_per_key_keeps_null_key_and_column_order(spark):
    df = spark.createDataFrame([(2.0, 10, "x"), (1.0, 10, "y"), (5.0, None, "z")], "lat double, zip int, city string")
    first = grouping.first_row_per_key(df, "zip", ["lat", "city"])
    assert first.columns == df.columns
    assert {tuple(r) for r in first.collect()} == {(1.0, 10, "y"), (5.0, None, "z")}
    # A hot key is cut to one row per task before it moves, and no aggregate sorts whole rows.
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "SortAggregate" not in plan


def test_quality_reports(spark):
    clean = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    dirty = spark.createDataFrame([(1, None), (1, None), (1, "x"), (None, None)], "id int, s string")
    tables = {"clean": clean, "dirty": dirty}
    assert {(r.table_name, r.row_count) for r in quality.row_counts(tables).collect()} == {("clean", 2), ("dirty", 4)}
    assert {tuple(r) for r in quality.null_counts(tables).collect()} == {("dirty", "id", 1), ("dirty", "s", 3)}
    assert {tuple(r) for r in quality.duplicate_rows(tables).collect()} == {("clean", 0), ("dirty", 1)}
    assert quality.issue_count(tables).first().issues == 2
    assert quality.issue_count({"clean": clean}).first().issues == 0


def test_duplicates_are_told_apart_from_rows_of_equal_hash(spark):
    """Nulls do not enter the hash, so these rows share one; only the last repeats another."""
    df = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    assert df.select(F.xxhash64("a", "b")).distinct().count() == 1
    assert quality.duplicate_rows({"t": df}).first().duplicate_rows == 1
    nothing = spark.createDataFrame([], "a int, b int")
    assert quality.duplicate_rows({"t": nothing}).first().duplicate_rows == 0
    assert quality.issue_count({"t": nothing}).first().issues == 0


@pytest.mark.parametrize("values", [list(range(61)), [3], [-20, -20, 7, 59, 0, 0, 13], [0, 40], [1, 2, 2, 5]])
def test_histogram_equals_numpy(spark, values):
    counts = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").agg(F.count("*").alias("n"))
    bins = distribution.equal_width_histogram(counts, "v", "n", 40).collect()
    expected, edges = np.histogram(values, bins=40)
    assert [b.n for b in bins] == expected.tolist()
    assert np.allclose([b.bin_start for b in bins] + [bins[-1].bin_end], edges)


def test_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "v long, n long")
    assert distribution.equal_width_histogram(empty, "v", "n", 40).collect() == []


def test_shares_and_fixed_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    rows = distribution.counted_shares(df, "k", "n").collect()
    assert [(r.k, r.n) for r in rows] == [("b", 2), ("a", 1)]
    assert rows[1].share_pct == pytest.approx(100 / 3)
    counts = df.dropna().groupBy("k").count()
    ordered = distribution.in_fixed_order(counts, "k", ("c", "b", "a")).collect()
    assert [(r.k, r.position, r["count"]) for r in ordered] == [("c", 1, None), ("b", 2, 2), ("a", 3, 1)]


def test_rows_at_ranks_equal_a_sort(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([None, Decimal("0.01") * draw.randrange(-500, 500), Decimal(draw.randrange(3))]),
             draw.choice([None, draw.randrange(-(10**17), 10**17), 10**17, 10**17 - 1])) for i in range(-150, 250)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, a decimal(18,2), b bigint")
    ranks = [1, 2, 100, 101, 200, 301, 399, 400]
    got = rows_at(df, {"a": F.col("a"), "b": -F.col("b")}, "id", ranks)
    for at, sign, name in ((1, 1, "a"), (2, -1, "b")):
        ordered = sorted(((r[at] is None, sign * (r[at] or 0), r[0]) for r in rows))
        want = [(None if missing else value, key) for missing, value, key in (ordered[k - 1] for k in ranks)]
        assert got[name] == want
    with pytest.raises(ValueError):
        rows_at(df, {"a": F.col("a")}, "id", [401])


def test_quartiles_of_ten_million_equal_values_need_no_sort(spark):
    df = spark.range(10_000_000).select(F.col("id").alias("key"), F.lit(5).alias("v"))
    tiled = with_tiles(df, {"tile": F.col("v")}, "key")
    got = tiled.groupBy("tile").agg(F.count("*").alias("n"), F.min("key").alias("first")).orderBy("tile").collect()
    assert [tuple(r) for r in got] == [(t + 1, 2_500_000, t * 2_500_000) for t in range(4)]
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan


def test_metrics_of_a_table_in_one_pass(spark):
    rows = [(1, None, "a"), (1, "a", None), (1, None, "a"), (None, None, None), (None, None, None), (2, "", "x")]
    df = spark.createDataFrame(rows, "id int, `a.b` string, copies string")
    got = {tuple(r) for r in quality.table_metrics({"t": df, "none": df.limit(0)}).collect()}
    want = {("t", "id", 6, 2, 2), ("t", "a.b", 6, 4, 2), ("t", "copies", 6, 3, 2)}
    assert got == want | {("none", c, 0, 0, 0) for c in df.columns}
