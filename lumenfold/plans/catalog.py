"""All registered queries outside the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["windows", "accounts", "posts", "studies", "style", "people", "cohorts", "matching", "flat", "closing"]
_all = [import_module(f".{m}", __package__) for m in MODULES]
QUERIES = {name: f for m in _all for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _all for name, sql in m.ORACLES.items()}
