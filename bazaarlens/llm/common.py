"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text is empty. Other columns, whatever their names, are left out."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str | Column, folds: int) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo ``folds``; null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string")) % folds


def in_fold(id_col: str, folds: int, which: int) -> Column:
    """Whether a row is in the fold; a null id is in none."""
    return F.coalesce(fold(id_col, folds) == which, F.lit(False))


#: Text bytes that a step in Python takes at once.
MOST_BYTES = 1 << 23

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Python workers ``MOST_BYTES`` at once at most.

    With Spark's 64 MB every task holds a batch in the worker and in the executor, beside the heap. A
    lower setting stays. Only the size of batches changes, never what comes out.
    """
    spark = df.sparkSession
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES))
    if not 0 < held <= MOST_BYTES:
        spark.conf.set(_BATCH_BYTES, str(MOST_BYTES))
    return df


#: What steps keep in this Python worker from task to task, by the name they give it.
_KEPT: dict[str, object] = {}


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once and kept until another step runs in this worker."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def leave_to(name: str | None) -> None:
    """Drop what others than ``name`` keep: Spark hands its workers on, and they would hold it until they end."""
    others = [k for k in _KEPT if k != name]
    for other in others:
        del _KEPT[other]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task. Then its worker, which Spark keeps for later tasks, gives back what it freed."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidy


def map_texts(
    df: DataFrame,
    kept: Sequence[str],
    compute: Callable[[list[str]], Mapping[str, Sequence]],
    added: Mapping[str, str],
    rows_at_once: int = 1024,
    keeps: str | None = None,
) -> DataFrame:
    """Rows of ``df`` with columns computed from lists of whole texts (column ``text``), where they lie.

    ``added`` names the new columns with their types. The kept columns pass through as they are. ``keeps``
    is the name of what ``compute`` keeps in its worker, see ``kept_in_worker``; anything else is dropped there.
    """
    types = [df.schema[c].dataType.simpleString() for c in kept]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*zip(kept, types, strict=True), *added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_to(keeps)
        for batch in batches:
            for part in bounded_slices(batch, "text", rows_at_once):
                result = compute([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column(c) for c in kept] + [_array(result[c], t) for c, t in added.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return short_batches(df).select(*kept, *[c for c in ["text"] if c not in kept]).mapInArrow(tidied(run), schema)


def bounded_slices(
    batch: pa.RecordBatch, text: str, most_rows: int = 1024, most_bytes: int = MOST_BYTES
) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of few rows and bytes of text; a longer text is a piece of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = held = 0
    for i, length in enumerate(lengths):
        if i > begin and (held + length > most_bytes or i - begin == most_rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += length
    if begin < len(lengths):
        yield batch.slice(begin)


_ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def _array(values: Sequence, kind: str) -> pa.Array:
    return pa.array(values, type=_ARROW[kind])
