"""Raw files to star schema: ``python -m bazaarlens.jobs.build_star RAW_DIR STAR_DIR``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.model import Mart
from bazaarlens.operators import quality
from bazaarlens.plans.build import build_mart
from bazaarlens.session import job_session
from bazaarlens.sources.raw_csv import read_raw, reject_counts, without_source_order
from bazaarlens.sources.star_store import read_star, write_star
from bazaarlens.workspace import at_once, materialize

log = logging.getLogger(__name__)


def land(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parse every file once; reports and joins then read columns instead of text."""

    def step(name: str, df: DataFrame):
        return lambda: materialize(df, f"raw-{name}")

    return at_once({name: step(name, df) for name, df in raw.items()})


def log_quality(raw: dict[str, DataFrame]) -> int:
    """Log row counts, nulls and duplicates; returns the number of issues."""
    # One line per column of nine tables, from one pass over each.
    lines = quality.table_metrics(without_source_order(raw)).collect()
    tables = {line.table_name: line for line in lines}
    for name, line in tables.items():
        log.info("%s: %s rows", name, f"{line.row_count:,}")
    with_nulls = [line for line in lines if line.null_count]
    with_copies = [line for line in tables.values() if line.duplicate_rows]
    for line in with_nulls:
        log.warning("%s.%s: %s nulls", line.table_name, line.column_name, f"{line.null_count:,}")
    for line in with_copies:
        log.warning("%s: %s duplicate rows", line.table_name, f"{line.duplicate_rows:,}")
    issues = len({line.table_name for line in with_nulls}) + len(with_copies)
    log.info("%s issue(s) found", issues)
    return issues


def run(spark: SparkSession, raw_dir: str, star_dir: str, fmt: str = "parquet", check: bool = True) -> Mart:
    raw = land(read_raw(spark, raw_dir))
    if check:
        log_quality(raw)
        # Few rows: columns with cells that were read as null because they cannot be parsed.
        for line in reject_counts(spark, raw_dir).collect():
            log.warning("%s.%s: %s cells rejected", line.table_name, line.column_name, f"{line.rejected:,}")
    write_star(build_mart(raw), star_dir, fmt)
    return read_star(spark, star_dir, fmt)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("raw_dir")
    parser.add_argument("star_dir")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--no-checks", action="store_true", help="skip the quality report")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)s | %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = job_session("build-star")
    mart = run(spark, options.raw_dir, options.star_dir, options.format, not options.no_checks)
    for line in quality.row_counts(mart.tables()).collect():
        log.info("stored %s: %s rows", line.table_name, f"{line.row_count:,}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
