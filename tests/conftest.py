from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bazaarlens.model import STAR_SCHEMAS, Mart  # noqa: E402
from bazaarlens.plans.build import calendar  # noqa: E402
from bazaarlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # A session time zone with daylight saving time: results must not depend on it.
    session = local_session("tests", 4, **{"spark.sql.session.timeZone": "America/Sao_Paulo"})
    yield session
    session.stop()


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


@pytest.fixture
def make_mart(spark):
    """A mart from a list of fact rows given as dicts; dimensions can be given or stay empty."""

    def make(facts: list[dict], first: date, last: date, **dims: list[dict]) -> Mart:
        def frame(name: str, rows: list[dict]):
            schema = STAR_SCHEMAS[name]
            return spark.createDataFrame(
                [tuple(row.get(field) for field in schema.names) for row in rows], schema
            )

        span = spark.createDataFrame([(first, last)], "first_day date, last_day date")
        rows = [
            {
                "order_id": f"o{i}",
                "order_status": "delivered",
                "is_late": 0,
                **fact,
                "total_payment": money(fact.get("total_payment")),
                "total_price": money(fact.get("total_price")),
                "total_freight": money(fact.get("total_freight")),
            }
            for i, fact in enumerate(facts)
        ]
        return Mart(
            fact=frame("fact_orders", rows),
            dim_date=calendar(span),
            dim_customer=frame("dim_customer", dims.get("customers", [])),
            dim_product=frame("dim_product", dims.get("products", [])),
            dim_seller=frame("dim_seller", dims.get("sellers", [])),
            dim_geography=frame("dim_geography", dims.get("geography", [])),
        )

    return make


def moment(text: str) -> datetime:
    return datetime.fromisoformat(text)
