"""Queries over the provided tables, each next to its SQL equivalent."""

from __future__ import annotations

import importlib
from dataclasses import dataclass

from tandemlens.plans.catalog import QUERIES, SQL, Query

FAMILIES = (
    "evaluation",
    "profiling",
    "corpora",
    "graphs",
    "tracking",
    "readiness",
    "limits",
    "files",
    "neural",
    "representation",
    "retrieval",
    "sketching",
    "statistics",
    "experiment",
    "streams",
)


@dataclass(frozen=True)
class Registered:
    queries: dict[str, Query]
    sql: dict[str, str]


def registered() -> Registered:
    """Import every family once and return what they registered."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return Registered(QUERIES, SQL)
