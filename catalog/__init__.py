"""Registered queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from . import (  # noqa: F401  (importing registers the queries)
    aggregates,
    cleaning,
    composites,
    expressions,
    joins,
    models,
    sources,
    splits,
    streams,
)
from .registry import ENTRIES

__all__ = ["ENTRIES"]
