"""Table bindings and registered queries."""

from __future__ import annotations

import importlib

FAMILIES = [
    "trace_queries", "program_queries", "sweep_queries", "split_queries", "matrix_queries", "design_queries", "run_queries", "source_queries",
]


def load_all() -> None:
    for name in FAMILIES:
        importlib.import_module(f"tracemill.plans.{name}")
