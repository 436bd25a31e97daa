"""All registered queries and their reference SQL."""

from __future__ import annotations

from . import aggregations, claims, features, io, joins, ledger, marts, projections, quality, scalars, serving, sets, windows  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return ORACLES
