"""All registered queries and their SQL oracles."""

from __future__ import annotations

import importlib

_MODULES = ["deid_queries", "term_queries", "bio_queries", "ledger_queries", "impute_queries", "stream_queries", "learn_queries",
            "file_queries"]


def _mods():
    return [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]


def queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _mods():
        out.update(getattr(m, "ORACLE", {}))
    return out
