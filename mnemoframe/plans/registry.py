"""All queries of the library and the SQL they are compared with; modules of this package each bring QUERIES and ORACLE."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("core", "scalars", "retrieval", "more", "paths")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"mnemoframe.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"mnemoframe.plans.{m}").ORACLE.items()}
