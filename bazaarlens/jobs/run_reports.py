"""All report series, optionally sliced:
``python -m bazaarlens.jobs.run_reports STAR_DIR REPORT_DIR [--year 2017] [--category ..] [--state ..]``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame

from bazaarlens.functions.display import format_measures
from bazaarlens.model import Mart
from bazaarlens.plans import customers, dashboard, delivery, measures, revenue, rfm
from bazaarlens.plans.cube import with_cube
from bazaarlens.plans.star import ALL, slice_mart, slicer_values
from bazaarlens.session import job_session
from bazaarlens.sources.star_store import read_star, write_result
from bazaarlens.workspace import materialize


def series(mart: Mart, rfm_result: DataFrame, segments: tuple[str, ...] = ()) -> dict[str, Callable[[], DataFrame]]:
    """Every chart and measure by name."""
    pages = {
        "revenue": dashboard.revenue_page(mart),
        "delivery": dashboard.delivery_page(mart),
        "customers": dashboard.customer_page(mart, rfm_result, segments),
    }
    return {
        **{f"{page}_{name}": make for page, parts in pages.items() for name, make in parts.items()},
        "revenue_monthly_aov_mean": lambda: revenue.monthly_aov_mean(mart),
        "revenue_top_states": lambda: revenue.top_states(mart),
        "revenue_leader_share": lambda: revenue.leader_share(mart),
        "revenue_heatmap": lambda: revenue.revenue_heatmap(mart),
        "delivery_histogram_lt60": lambda: delivery.delivery_histogram_lt60(mart),
        "delivery_freight_pct_by_category": lambda: delivery.freight_pct_by_category(mart),
        "customers_repeat_buyers": lambda: customers.repeat_buyers(mart),
        "customers_repeat_order_histogram": lambda: customers.repeat_order_histogram(mart),
        "customers_five_star_pct": lambda: customers.five_star_pct(mart),
        "order_status_breakdown": lambda: customers.order_status_breakdown(mart),
        "share_of_total": lambda: dashboard.share_of_total(mart, rfm_result),
        "slicer_values": lambda: slicer_values(mart),
        "measure_totals": lambda: measures.measure_totals(mart),
        "measure_totals_text": lambda: format_measures(measures.measure_totals(mart)),
        "late_rate_status": lambda: measures.late_rate_status(mart),
        "revenue_yoy": lambda: measures.revenue_yoy(mart),
        "rolling_30d_calendar": lambda: measures.rolling_30d_calendar(mart),
        "revenue_mtd": lambda: measures.revenue_mtd(mart),
    }


def run(
    mart: Mart,
    report_dir: str,
    year: int | str = ALL,
    category: str = ALL,
    state: str = ALL,
    segments: tuple[str, ...] = (),
    fmt: str = "csv",
) -> list[str]:
    """Store every series; the customer table itself is never sliced. Returns where they are.

    The fact is read three times: for the customer table and twice for the report cube.
    """
    rfm_result = materialize(rfm.rfm_segments(mart), "rfm")
    sliced = slice_mart(with_cube(mart), year, category, state)
    return [write_result(make(), report_dir, name, fmt) for name, make in series(sliced, rfm_result, segments).items()]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("star_dir")
    parser.add_argument("report_dir")
    parser.add_argument("--year", default=ALL)
    parser.add_argument("--category", default=ALL)
    parser.add_argument("--state", default=ALL)
    parser.add_argument("--segment", action="append", default=[])
    parser.add_argument("--star-format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--report-format", choices=("parquet", "csv"), default="csv")
    options = parser.parse_args(arguments)
    spark = job_session("run-reports")
    stored = run(
        read_star(spark, options.star_dir, options.star_format),
        options.report_dir,
        options.year,
        options.category,
        options.state,
        tuple(options.segment),
        options.report_format,
    )
    print(*stored, sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
