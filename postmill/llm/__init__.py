"""Operators of a training-data pipeline: quality, toxicity, duplicates, leaks, language, extraction, mixing, search."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkContext

# Python workers import this package. Where it is installed, or sent along, they find it anyway; a session that runs from a
# checkout finds it by this path, whether the session starts before or after the import.
_ROOT = str(Path(__file__).resolve().parents[2])


def _with_root(path: str) -> str:
    parts = [p for p in path.split(os.pathsep) if p]
    return os.pathsep.join(parts if _ROOT in parts else [*parts, _ROOT])


os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH", ""))
if SparkContext._active_spark_context is not None:
    _environment = SparkContext._active_spark_context.environment
    _environment["PYTHONPATH"] = _with_root(_environment.get("PYTHONPATH", ""))
