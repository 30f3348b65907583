"""The registered queries: every module that holds one is imported here."""

from __future__ import annotations

from . import bisectors, byte_pairs, decontaminate, divergence, edit_embedding, jaccard, language_id, lm_score, packing, pii, quality, suffix_dedup, url_filter  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
