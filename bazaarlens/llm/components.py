"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import tidied
from bazaarlens.workspace import materialize, release


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as stars around the smallest node of each of its components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        tied = [(x, root(x)) for x in list(parent)]
        tied = [(x, r) for x, r in tied if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in tied], pa.int64()), pa.array([r for _, r in tied], pa.int64())], names=["a", "b"]
        )


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``links`` (``a, b``, whole numbers), the smallest node it reaches.

    Links of a node with itself, repeated links and both directions do no harm. Each round is written
    to the shared folder. A hot node is one row per neighbour and never gathered. Labels only fall, so
    the rounds end: after about the logarithm of the longest path, squared at worst.
    """
    edges = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    edges = materialize(edges.mapInArrow(tidied(_forest), "a bigint, b bigint").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialize(large.filter("a <> b").distinct(), "links")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
        last, edges = edges, materialize(small.filter("a <> b").distinct(), "links")
        release(last, down)
        # Exclusive or does not overflow, whatever the size of the ids.
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1)))).first()
        if state == before:
            break
        before = state
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
