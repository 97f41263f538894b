"""Profile the raw files: ``python -m bazaarlens.jobs.profile_raw RAW_DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.operators import quality
from bazaarlens.session import job_session
from bazaarlens.sources.raw_csv import RAW_FILES, missing_files, read_raw, reject_counts, without_source_order


def profile(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame | None, DataFrame | None]:
    """Names of tables without a file; rows, nulls and duplicates, and rejected cells, of all others."""
    absent = missing_files(spark, folder)
    present = [name for name in RAW_FILES if name not in absent]
    if not present:
        return absent, None, None
    tables = without_source_order(read_raw(spark, folder, names=present))
    return absent, quality.table_metrics(tables), reject_counts(spark, folder, names=present)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("raw_dir")
    options = parser.parse_args(arguments)
    spark = job_session("profile-raw")
    absent, report, rejected = profile(spark, options.raw_dir)
    for name in absent:
        print(f"missing: {name} ({RAW_FILES[name]})")
    if report is None:
        return 1
    # One line per column of nine tables at most.
    for line in report.orderBy("table_name", "column_name").collect():
        print(
            f"{line.table_name}.{line.column_name}: {line.row_count} rows, {line.null_count} null, "
            f"{line.duplicate_rows} duplicate rows in the table"
        )
    for line in rejected.orderBy("table_name", "column_name").collect():
        print(f"{line.table_name}.{line.column_name}: {line.rejected} cells rejected")
    return 1 if absent else 0


if __name__ == "__main__":
    raise SystemExit(main())
