from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellarline.session import local_session  # noqa: E402
from cellarline.sources.fact import SALES_SCHEMA  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def sales(spark):
    """Builds a fact from short rows; what is left out gets a plain value."""

    def build(*rows: dict):
        filled = []
        for row in rows:
            day = dt.date.fromisoformat(row.get("fecha", "2024-05-10"))
            sale = Decimal(str(row.get("venta", 100)))
            cost = Decimal(str(row.get("costo", 60)))
            filled.append(
                (
                    row.get("cod", 1),
                    row.get("cliente", "A"),
                    day,
                    day.month,
                    row.get("producto", "P"),
                    row.get("marca", "M"),
                    row.get("tipo", "Vino Tinto"),
                    row.get("pais", "Chile"),
                    row.get("vendedor", "V"),
                    row.get("cantidad", 1),
                    sale,
                    cost,
                    sale - cost,
                    row.get("estado", "F"),
                    day.year,
                )
            )
        return spark.createDataFrame(filled, SALES_SCHEMA)

    return build


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by(df, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
