"""The three analyses: ``python -m bazaarlens.jobs.run_queries STAR_DIR RESULT_DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from bazaarlens.functions.display import money
from bazaarlens.model import Mart
from bazaarlens.operators.quality import row_counts
from bazaarlens.plans import cohort, revenue, rfm
from bazaarlens.session import job_session
from bazaarlens.sources.star_store import read_star, write_result
from bazaarlens.workspace import materialize


def run(mart: Mart, result_dir: str, fmt: str = "csv") -> list[str]:
    """Store the results; returns lines of a summary."""
    summary = [f"{line.table_name}: {line.row_count:,} rows" for line in row_counts(mart.tables()).collect()]

    rolling = materialize(revenue.rolling_revenue(mart), "rolling-revenue")
    write_result(rolling, result_dir, "01_rolling_revenue", fmt)
    peak = rolling.agg(money(F.max("rolling_30d_revenue")).alias("peak")).first().peak
    summary.append(f"rolling revenue: {rolling.count():,} days, peak of 30 days {peak}")

    retention = materialize(cohort.cohort_retention(mart), "cohort-retention")
    write_result(retention, result_dir, "02_cohort", fmt)
    summary.append(f"cohorts: {retention.count():,} cells")
    first_month = retention.filter("months_since_first = 1").agg(F.avg("retention_rate_pct").alias("mean")).first()
    if first_month["mean"] is not None:
        summary.append(f"mean retention after one month: {first_month['mean']:.2f}%")

    segments = materialize(rfm.rfm_segments(mart), "rfm")
    write_result(segments, result_dir, "03_rfm", fmt)
    for line in rfm.segment_distribution(segments).collect():
        summary.append(f"{line.segment}: {line.customers:,} customers ({line.share_pct:.1f}%)")
    return summary


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("star_dir")
    parser.add_argument("result_dir")
    parser.add_argument("--star-format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--result-format", choices=("parquet", "csv"), default="csv")
    options = parser.parse_args(arguments)
    spark = job_session("run-queries")
    print(*run(read_star(spark, options.star_dir, options.star_format), options.result_dir, options.result_format), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
