"""Queries of the core operators and their SQL, gathered from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "sources.readers", "operators.text_ops", "operators.labels", "operators.sampling", "operators.ranking_ops", "operators.moments",
    "operators.rollups", "operators.scoring", "operators.certificates", "operators.evaluation", "streaming.micro",
]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"plumbline.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
