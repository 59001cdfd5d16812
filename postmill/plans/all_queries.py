"""Importing this module registers every query."""

import importlib
import pkgutil

import postmill.plans as plans
from postmill.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"postmill.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
