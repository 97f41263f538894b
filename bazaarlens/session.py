"""Spark session for the command-line jobs, the benchmark and the tests.

Library functions never build a session: they use the one their input frames belong to.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the jobs rely on. Sizes (shuffle partitions, executor memory) stay with the cluster.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def job_session(app_name: str, **settings: str) -> SparkSession:
    """Session with the job settings; the master comes from spark-submit or the defaults file."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**JOB_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app_name: str, cores: int | str = 8, **settings: str) -> SparkSession:
    """Single-JVM session for tests and local benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**JOB_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
