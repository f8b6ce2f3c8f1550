"""Collects every registered query."""

from __future__ import annotations

from . import q_batch, q_calls, q_catalog, q_docs, q_layout, q_review  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
