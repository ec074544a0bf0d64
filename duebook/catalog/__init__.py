"""Every operator as a runnable query over the test tables, with the SQL that states its result."""

import importlib

from duebook.catalog.base import QUERIES, SQL

MODULES = ["tables", "features", "cash", "collect", "scores", "profile", "scripts", "learning", "closed", "streams"]


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"duebook.catalog.{m}")
    return QUERIES, SQL
