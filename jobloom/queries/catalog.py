"""All registered queries."""

import importlib

from jobloom.queries.base import INVENTORY, ORACLES, QUERIES

AREAS = ["projections", "selections", "rollup", "changes", "searching", "matches", "audits", "streams", "feeds"]
for area in AREAS:
    importlib.import_module(f"jobloom.queries.{area}")

__all__ = ["INVENTORY", "ORACLES", "QUERIES"]
