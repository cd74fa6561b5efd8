"""All registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from shelfspark.plans import books, catalogue, dedup, ledger, linkage, records, streaming, texts  # noqa: F401
from shelfspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
