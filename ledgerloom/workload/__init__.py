"""The registered queries: the library applied to the given tables."""

from __future__ import annotations

import importlib

from ledgerloom.workload.registry import ORACLES, QUERIES, Query

MODULES = ("rule_queries", "money_queries", "ingest_queries", "mapping_queries", "stream_queries")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"ledgerloom.workload.{module}")
    return QUERIES, ORACLES
