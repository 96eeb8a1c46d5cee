"""All queries of the library, by name, with the SQL that DuckDB can check them with."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from . import plans
from .registry import ORACLES, QUERIES

for _module in iter_modules(plans.__path__):
    import_module(f"{plans.__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
