"""Global row numbers and equal-sized tiles without a single-task window.

Rows are range-partitioned on an order that ends in a unique column, so that a value shared by any
number of rows is still spread over many tasks. The position inside a partition plus the size of
all earlier partitions is the global position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.workspace import materialize

_SLOT = "__slot"
_PART = "__part"
_BEFORE = "__before"
# monotonically_increasing_id keeps the partition number above this many bits of row number.
_ROW_BITS = 33


def dense_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name`` = 1..n in the given order, whose columns must identify a row.

    The sorted rows are stored once, so both the partition sizes and the final read see the same
    partition bounds.
    """
    stored = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_SLOT, F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright(_SLOT, _ROW_BITS)
    row = F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = stored.groupBy(part.alias(_PART)).agg((F.max(row) + 1).alias("size"))
    # One row per range partition: bounded by the shuffle partition setting, not by the data.
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(_BEFORE))
    return (
        stored.withColumn(_PART, part)
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col(_BEFORE) + row + 1)
        .select(*df.columns, name)
    )


def file_index(df: DataFrame, place: str, name: str, whole: bool = False) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``place``, a struct ``file, block, row`` of a table read from files.

    No global sort: the rows of every block of a file are counted, blocks are put in order, and a row
    adds its place inside its block to the sizes of all earlier blocks. ``row`` rises inside a block,
    which is a unit of reading and so bounded. With ``whole``, every row that was read is still there,
    once, and the place inside a block is the distance to its first row; otherwise the rows of a block
    are ranked, which moves them to one task per block.
    """
    file, block, row = (F.col(f"{place}.{part}") for part in ("file", "block", "row"))
    parts = df.withColumns({"__file": file, "__block": block})
    keys = ["__file", "__block"]
    sizes = parts.groupBy(*keys).agg(F.count("*").alias("__size"), F.min(row).alias("__first"))
    # One row per block of a file: as many as there are tasks that read the table.
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__first", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias(_BEFORE))
    if whole:
        inside = row - F.col("__first") + 1
    else:
        parts = parts.withColumn(_SLOT, F.row_number().over(Window.partitionBy(*keys).orderBy(row)))
        inside = F.col(_SLOT)
    return parts.join(offsets, keys).withColumn(name, F.col(_BEFORE) + inside).select(*df.columns, name)


def tile_starts(rows: int, tiles: int) -> list[int]:
    """1-based positions where tiles 2..k begin; the first ``rows % tiles`` tiles get one row more."""
    size, rest = divmod(rows, tiles)
    starts = [tile * size + min(tile, rest) + 1 for tile in range(1, tiles)]
    return [start for start in starts if start <= rows]


#: Into how many ranges an interval is cut per round.
_RANGES = 256


@dataclass
class _Search:
    """A wanted row of one measure: its rank among the rows whose ``value``, or ``key`` at a known value, is in an interval."""

    measure: str
    rank: int
    low: Decimal | None
    high: Decimal | None
    at_key: bool = False
    value: Decimal | None = None

    @property
    def found(self) -> bool:
        return self.at_key and self.low == self.high


def rows_at(
    df: DataFrame, measures: Mapping[str, Column], key: str, ranks: Sequence[int]
) -> dict[str, list[tuple[Decimal | None, int]]]:
    """``(value, key)`` of the rows at the given ranks of each measure: ascending, nulls last, ties by ``key``.

    Selection by counting: the interval that holds a wanted row is cut into ranges, the rows of each
    are counted with their least and largest value, and the range that holds the row is cut again.
    Ranges need not be exact, only in order, as the bounds found are values of rows. Once a value is
    known, the keys of its rows are searched in the same way, so equal values do not matter.

    A round is one pass in which tasks count and send a row per range; nothing is sorted or written.
    Measures are whole numbers or decimals, keys are whole numbers and identify a row.
    """
    value_type, key_type = T.DecimalType(38, 6), T.DecimalType(20, 0)
    columns = {name: column.cast(value_type) for name, column in measures.items()}
    number = F.col(key).cast(key_type)
    whole = df.agg(
        F.count("*"), F.min(number), F.max(number),
        *[f(c) for c in columns.values() for f in (F.count, F.min, F.max)],
    ).first()
    rows, first_key, last_key = whole[:3]
    searches: list[_Search] = []
    for i, name in enumerate(columns):
        present, low, high = whole[3 + 3 * i : 6 + 3 * i]
        for rank in ranks:
            if not 1 <= rank <= rows:
                raise ValueError(f"there is no row {rank} among {rows}")
            if rank <= present:
                searches.append(_Search(name, rank, low, high))
            else:
                searches.append(_Search(name, rank - present, first_key, last_key, at_key=True))

    def settle(search: _Search) -> None:
        if not search.at_key and search.low == search.high:
            search.value, search.at_key = search.low, True
            search.low, search.high = first_key, last_key

    def place(i: int, search: _Search) -> Column:
        """Search, range and number of a row; no range outside the interval."""
        column = number if search.at_key else columns[search.measure]
        kind = key_type if search.at_key else value_type
        low, high = (F.lit(x).cast(kind) for x in (search.low, search.high))
        inside = column.between(low, high)
        if search.at_key:
            inside &= columns[search.measure].eqNullSafe(F.lit(search.value).cast(value_type))
        share = (column - low).cast("double") / (high - low).cast("double")
        part = F.least(F.floor(share * _RANGES), F.lit(_RANGES - 1))
        return F.struct(
            F.lit(i).alias("search"), F.when(inside, part).alias("part"), column.cast(value_type).alias("number")
        )

    for search in searches:
        settle(search)
    while open_searches := [s for s in searches if not s.found]:
        lines = F.array(*[place(i, s) for i, s in enumerate(open_searches)])
        counted = (
            df.select(F.inline(lines)).filter("part IS NOT NULL")
            .groupBy("search", "part").agg(F.count("*").alias("rows"), F.min("number").alias("low"), F.max("number").alias("high"))
            .collect()
        )
        for i, search in enumerate(open_searches):
            for part in sorted((r for r in counted if r["search"] == i), key=lambda r: r["part"]):
                if search.rank <= part["rows"]:
                    search.low, search.high = part["low"], part["high"]
                    break
                search.rank -= part["rows"]
            settle(search)
    found: dict[str, list[tuple[Decimal | None, int]]] = {name: [] for name in columns}
    for search in searches:
        found[search.measure].append((search.value, int(search.low)))
    return found


def with_tiles(df: DataFrame, measures: Mapping[str, Column], key: str, tiles: int = 4) -> DataFrame:
    """Add one tile number 1..k per measure, each ranked ascending, nulls last, ties by ``key``.

    Only the first row of every tile matters: ``(k - 1) * len(measures)`` rows found by counting, see
    ``rows_at``. The tiles are then plain comparisons on ``df``, with no join back. ``df`` should be
    a stored table, as it is read a few times.
    """
    value_type = T.DecimalType(38, 6)
    key_type = df.schema[key].dataType
    starts = tile_starts(df.count(), tiles)
    cuts = rows_at(df, measures, key, starts) if starts else {name: [] for name in measures}

    def tile(name: str, value: Column) -> Column:
        def place(value: Column, key: Column) -> Column:
            return F.struct(value.isNull().alias("absent"), value.alias("value"), key.alias("key"))

        here = place(value.cast(value_type), F.col(key))
        passed = [
            F.when(here >= place(F.lit(v).cast(value_type), F.lit(k).cast(key_type)), 1).otherwise(0) for v, k in cuts[name]
        ]
        return sum(passed, F.lit(1)).cast("bigint").alias(name)

    return df.select("*", *[tile(name, value) for name, value in measures.items()])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of an order that leaves no ties; each task keeps only ``k`` rows."""
    return df.orderBy(*order).limit(k)
