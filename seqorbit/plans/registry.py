"""Collects the registered queries of every catalog module."""

from __future__ import annotations

import importlib

_MODULES = ("catalog", "catalog_splits", "catalog_scoring", "catalog_paths", "catalog_sinks",
            "catalog_extra", "catalog_training", "catalog_datasets")


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    from . import catalog
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracle_sql():
    return dict(_load().ORACLE)


def query_ids():
    return dict(_load().IDS)
