"""Sales, customer, ledger and forecast analytics as DataFrame operators on Apache Spark."""

from cellarline.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
