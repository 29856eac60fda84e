"""Every query by key, with its DuckDB form where there is one."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES

for _found in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_found}")

__all__ = ["ORACLES", "QUERIES"]
