"""Queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from .plans import coverages, display, distance, evidence, flows, names, overlays, relational, rules, settlements, territories

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (distance, relational, flows, evidence, coverages, rules, overlays, settlements, territories, names, display):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
