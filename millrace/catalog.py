"""All queries and oracles of the library's own operators, by operator id."""

from __future__ import annotations

import importlib
import pkgutil

from millrace import queries as _queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in pkgutil.iter_modules(_queries.__path__):
    if _module.name == "registry":
        continue
    _m = importlib.import_module(f"{_queries.__name__}.{_module.name}")
    QUERIES |= _m.Q.queries
    ORACLES |= _m.Q.oracles
