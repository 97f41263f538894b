"""Raw marketplace CSV files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.model import RAW_SCHEMAS, SOURCE_ORDER

# File of each raw table, below the raw folder.
RAW_FILES = {
    "orders": "*orders_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "products": "*products_dataset.csv",
    "customers": "*customers_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "payments": "*order_payments_dataset.csv",
    "reviews": "*order_reviews_dataset.csv",
    "geo": "*geolocation_dataset.csv",
    "category_xlat": "product_category_name_translation.csv",
}

# Free text may hold line breaks; such a file cannot be split, so only this table pays for it.
_MULTILINE = {"reviews"}

# Cell texts that mean "missing" besides the empty cell.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _present(name: str) -> Column:
    """The text of a cell, null if it means "missing"."""
    text = F.col(f"`{name}`")
    return F.when((text != "") & ~text.isin(*MISSING_TEXTS), text)


def _typed(name: str, kind: T.DataType | None) -> Column:
    """The value of a cell; null if it is missing or cannot be parsed, see ``rejects``."""
    present = _present(name)
    if kind is None or isinstance(kind, T.StringType):
        return present.alias(name)
    if isinstance(kind, T.IntegralType):
        # Whole numbers may be written as 4.0; others are no whole numbers.
        number = present.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast(kind).alias(name)
    return present.try_cast(kind).alias(name)


def _as_text(spark: SparkSession, path: str, schema: T.StructType, multiline: bool) -> DataFrame:
    """The cells of a file as they are written."""
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        # The first file names the columns; a file with another header is an error.
        .option("enforceSchema", False)
        .csv(path)
    )
    missing = [name for name in schema.names if name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return text


def _place() -> Column:
    """Where a row stands in its source: file, block, row."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Columns by header name, typed where ``schema`` names them, text otherwise.

    ``SOURCE_ORDER`` gives the place of the row: file, block, row. It stays unread unless used.
    """
    text = _as_text(spark, path, schema, multiline)
    known = {field.name: field.dataType for field in schema.fields}
    cells = [_typed(name, known.get(name)) for name in text.columns]
    return text.select(*cells, _place().alias(SOURCE_ORDER))


def rejects(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """``column_name, value, file, block, row`` of every cell that is present but not of its column's type.

    ``read_csv`` reads such a cell as null. One pass; rows without a bad cell end in their task.
    """
    text = _as_text(spark, path, schema, multiline)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    if not typed:
        return spark.createDataFrame([], "column_name string, value string, file string, block bigint, row bigint")
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.when(_typed(f.name, f.dataType).isNull(), _present(f.name)).alias("value"),
        )
        for f in typed
    ]
    bad = F.filter(F.array(*cells), lambda c: c["value"].isNotNull())
    # Rows are numbered before those without a bad cell end.
    placed = text.select(bad.alias("cells"), _place().alias("place"))
    return placed.select("place", F.inline("cells")).select("column_name", "value", "place.*")


def reject_counts(
    spark: SparkSession, folder: str, files: Mapping[str, str] = RAW_FILES, names: Iterable[str] = RAW_SCHEMAS
) -> DataFrame:
    """``table_name, column_name, rejected`` of all columns with cells that cannot be parsed; part of the quality report."""
    parts = [
        rejects(spark, f"{folder.rstrip('/')}/{files[name]}", RAW_SCHEMAS[name], name in _MULTILINE)
        .groupBy("column_name").agg(F.count("*").alias("rejected"))
        .select(F.lit(name).alias("table_name"), "column_name", "rejected")
        for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def _check_one_source(spark: SparkSession, path: str) -> None:
    """A table is one file, or one folder of files; another file that fits the pattern is an error."""
    ending = path.rsplit("/", 1)[-1].lstrip("*")
    sources = {f if f.endswith(ending) else f.rsplit("/", 1)[0] for f in spark.read.text(path).inputFiles()}
    if len(sources) > 1:
        raise ValueError(f"{path} fits more than one source: {', '.join(sorted(sources))}")


def read_raw(
    spark: SparkSession, folder: str, files: Mapping[str, str] = RAW_FILES, names: Iterable[str] = RAW_SCHEMAS
) -> dict[str, DataFrame]:
    """The nine raw tables, or those named, each from one file, or from one folder of files with the same header."""
    tables = {}
    for name in names:
        path = f"{folder.rstrip('/')}/{files[name]}"
        _check_one_source(spark, path)
        tables[name] = read_csv(spark, path, RAW_SCHEMAS[name], name in _MULTILINE)
    return tables


def missing_files(
    spark: SparkSession, folder: str, files: Mapping[str, str] = RAW_FILES
) -> list[str]:
    """Names of raw tables without a file."""
    absent = []
    for name, pattern in files.items():
        try:
            spark.read.text(f"{folder.rstrip('/')}/{pattern}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(name)
    return absent


def without_source_order(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as their files show them, for quality reports."""
    return {name: df.drop(SOURCE_ORDER) for name, df in tables.items()}
