"""The star schema and query results on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.model import FACT_PARTITION, STAR_SCHEMAS, Mart
from bazaarlens.workspace import at_once


# Blanks around a text are part of it.
_AS_WRITTEN = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# An empty cell is missing and a quoted empty one is an empty text, as no text equals this one.
_NO_TEXT = "\0"


def _layout(name: str, df: DataFrame) -> DataFrame:
    """File layout of a table.

    The fact gets a folder per year, is gathered by month and sorted by day inside a file: a year
    slice opens no file of other years, and a range of days skips whole row groups. The rebalance
    hint lets the adaptive planner split a month of any size into files of the advised size and join
    small ones.
    """
    if name != "fact_orders":
        return df
    by_month = df.withColumns({
        FACT_PARTITION: F.floor(F.col("date_key") / 10_000).cast("int"), "month_key": F.floor(F.col("date_key") / 100)
    }).hint("rebalance", F.col("month_key"))
    return by_month.sortWithinPartitions(FACT_PARTITION, "date_key").drop("month_key")


def _write(df: DataFrame, target: str, fmt: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if fmt == "csv":
        writer.options(header=True, escape='"', **_AS_WRITTEN).csv(target)
    else:
        writer.format(fmt).save(target)


def _target(folder: str, name: str, fmt: str) -> str:
    return f"{folder.rstrip('/')}/{name}" + (".csv" if fmt == "csv" else "")


def write_star(mart: Mart, folder: str, fmt: str = "parquet") -> None:
    """Write the six tables, as parquet or as CSV with a header."""

    def step(name: str, df: DataFrame):
        laid = _layout(name, df)
        if fmt == "csv":
            return lambda: _write(laid.drop(FACT_PARTITION), _target(folder, name, fmt), fmt)
        partition = FACT_PARTITION if name == "fact_orders" else None
        return lambda: _write(laid, _target(folder, name, fmt), fmt, partition)

    at_once({name: step(name, df) for name, df in mart.tables().items()})


def read_star(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    id_types: dict[str, T.DataType] | None = None,
) -> Mart:
    """Read the six tables with their fixed schemas.

    ``id_types`` overrides the type of source identifiers (text by default). CSV folders and single
    CSV files are both accepted; whole numbers written as ``4.0`` are read as whole numbers. A year
    slice of a fact that is stored by year opens the folder of that year only.
    """
    overrides = id_types or {}
    tables = {}
    for name, schema in STAR_SCHEMAS.items():
        schema = T.StructType([T.StructField(f.name, overrides.get(f.name, f.dataType)) for f in schema.fields])
        path = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            text = spark.read.options(header=True, escape='"', nullValue=_NO_TEXT, **_AS_WRITTEN).csv(f"{path}.csv")
            tables[name] = text.select(
                *[
                    (
                        F.col(f.name).cast("double").cast(f.dataType)
                        if isinstance(f.dataType, T.IntegralType)
                        else F.col(f.name).cast(f.dataType)
                    ).alias(f.name)
                    for f in schema.fields
                ]
            )
        else:
            tables[name] = spark.read.schema(schema).format(fmt).load(path)
    return Mart.from_tables(tables)


def write_result(df: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    """Store one query result; returns where."""
    target = _target(folder, f"result_{name}", fmt)
    _write(df, target, fmt)
    return target


def register_views(mart: Mart) -> None:
    """Make the tables visible to ``spark.sql`` under their names."""
    for name, df in mart.tables().items():
        df.createOrReplaceTempView(name)
