"""Intermediate tables in the folder all executors share.

A stage whose result is read more than once, or whose row positions must not move between two
reads, is written as parquet and read back. That cuts its lineage: a lost executor costs a re-read
and never a second computation with other partition bounds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in its settings; a local session may set its own."""
    configured = spark.conf.get(_SETTING, None)
    if not configured:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="bazaarlens-")
        spark.conf.set(_SETTING, configured)
    return configured.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_dir(spark)}/bazaarlens/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` returned. No later step may read them, and all that did are stored."""
    for df in stored:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]}:
            if "/bazaarlens/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(steps: Mapping[str, Callable[[], Result]]) -> dict[str, Result]:
    """Run independent steps side by side, so that small jobs share the cluster; all must succeed."""
    with ThreadPoolExecutor(max_workers=max(1, len(steps))) as pool:
        running = {name: pool.submit(step) for name, step in steps.items()}
        return {name: future.result() for name, future in running.items()}
