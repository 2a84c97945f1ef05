"""Registered queries of the time-series engine and their SQL."""

from __future__ import annotations

from geoloom.plans import kernel_queries, more_queries, native_queries, panel_queries, rule_queries, source_queries  # noqa: F401 - all register with native_queries

QUERIES: dict = {**native_queries.QUERIES}
ORACLES: dict[str, str] = {**native_queries.ORACLES}
