"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

from vellumine.workload.registry import ORACLES, QUERIES

MODULES = (
    "cleaning", "tokens", "labels", "chunks", "vectors", "retrieval", "rewriting",
    "contexts", "checks", "metrics", "catalog", "dialogue", "logbook", "files", "enhanced",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"vellumine.workload.{name}")
    return QUERIES, ORACLES
