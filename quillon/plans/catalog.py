"""All queries of the library by name."""

from __future__ import annotations

import importlib

MODULES = ("documents", "files", "identity", "quality", "ratings", "reading", "recommend", "resolve", "search", "stores", "upkeep")


def _modules() -> list:
    return [importlib.import_module(f"quillon.plans.{m}") for m in MODULES]


def flagship(spark, sf_dir: str):
    return queries()["general_recommendations"](spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _modules() for k, f in m.oracle_sql().items()}
