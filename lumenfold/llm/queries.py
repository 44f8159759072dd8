"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["crf", "substrings", "quality", "secrets", "jaccard", "licences", "exact_dedup", "mixing", "warc", "bpe"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f".{m}", __package__).ORACLES.items()}
