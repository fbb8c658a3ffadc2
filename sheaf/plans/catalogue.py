"""Catalogue of queries over the supplied tables, each with the SQL that must agree."""

from __future__ import annotations

from importlib import import_module

from sheaf.plans.registry import QUERIES, SQL, Query

MODULES = ("reports", "scans", "texts", "figures", "graphs", "matches", "ordered", "shapes", "pages", "streams", "papers", "forms")
FLAGSHIP = "feature_report"

for _module in MODULES:
    import_module(f"sheaf.plans.{_module}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
