"""CSV in and out must not change data."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from bazaarlens.sources import raw_csv, star_store


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,price,freight\nx,1,2\n")
    (tmp_path / "b.csv").write_text("id,freight,price\ny,10,1\n")
    schema = T.StructType([T.StructField("id", T.StringType())])
    with pytest.raises(Exception, match="(?i)header"):
        raw_csv.read_csv(spark, str(tmp_path), schema).collect()


def test_two_sources_of_a_table_are_an_error(spark, tmp_path):
    for prefix in ("old_", "new_"):
        (tmp_path / f"{prefix}orders_dataset.csv").write_text("order_id\nx\n")
    with pytest.raises(ValueError, match="more than one source"):
        raw_csv.read_raw(spark, str(tmp_path), {**raw_csv.RAW_FILES, "order_items": "*orders_dataset.csv"})


def test_blanks_empty_texts_and_quotes_survive(spark, tmp_path):
    rows = [(1, " sao paulo "), (2, ""), (3, None), (4, 'a "b", c'), (5, "NA")]
    star_store.write_result(spark.createDataFrame(rows, "k int, city string"), str(tmp_path), "x")
    back = spark.read.options(header=True, escape='"', nullValue=star_store._NO_TEXT, **star_store._AS_WRITTEN)
    got = back.csv(str(tmp_path / "result_x.csv")).collect()
    assert sorted((int(r["k"]), r["city"]) for r in got) == rows


def test_cells_that_cannot_be_parsed_are_null_and_reported(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,n,price,at,d\nx,4.0,1.25,2017-01-02 03:04:05,0.5\ny,4.5,one,soon,1e3\nz,many,,2017-13-01,nan\nw,99999999999,7,2017-01-01,much\n")
    kinds = {"n": T.IntegerType(), "price": T.DecimalType(18, 2), "at": T.TimestampNTZType(), "d": T.DoubleType()}
    schema = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(c, k) for c, k in kinds.items()]])
    rows = {r["id"]: r for r in raw_csv.read_csv(spark, str(path), schema).collect()}
    assert (rows["x"]["n"], float(rows["x"]["price"]), rows["x"]["at"].year, rows["x"]["d"]) == (4, 1.25, 2017, 0.5)
    assert [rows["y"][c] for c in ("n", "price", "at", "d")] == [None, None, None, 1000.0]
    bad = raw_csv.rejects(spark, str(path), schema).collect()
    assert sorted((r["column_name"], r["value"]) for r in bad) == [
        ("at", "2017-13-01"), ("at", "soon"), ("d", "much"), ("n", "4.5"), ("n", "99999999999"), ("n", "many"), ("price", "one"),
    ]
    assert {(r["column_name"], r["value"]): r["row"] for r in bad}["n", "many"] == 2
    assert all(r["file"].endswith("a.csv") for r in bad)
    assert raw_csv.rejects(spark, str(path), T.StructType([schema["id"]])).count() == 0
