"""Registered queries over the given tables, each with its SQL check where one exists."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = [
    "sweep_queries",
    "adapt_queries",
    "metric_queries",
    "result_queries",
    "source_queries",
    "model_queries",
    "model_sweep_queries",
]


def load_all() -> ModuleType:
    for name in MODULES:
        importlib.import_module(f"tidemark.catalog.{name}")
    return importlib.import_module("tidemark.catalog.registry")
