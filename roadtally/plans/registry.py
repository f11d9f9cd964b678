"""All registered queries of the traffic jobs."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["counts", "tables", "measures", "search", "paths", "calibration", "imports", "trajectories", "streams", "framing"]


def queries():
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"roadtally.plans.{name}").QUERIES
    return found


def oracle_sql():
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"roadtally.plans.{name}").ORACLES
    return found
