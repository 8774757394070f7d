"""Every operator bound to the driver's tables, next to the SQL that must give the same rows."""

from . import aggregates, features, models, pipelines, studies, texts, tests_stats  # noqa: F401
from .registry import REGISTRY


def queries() -> dict:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
