"""Queries over the benchmark tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["records", "classes", "report_text", "models"]


def entries() -> dict:
    """name -> (callable(spark, sf_dir), sql or None)"""
    out: dict = {}
    for m in MODULES:
        for name, pair in import_module(f"creditloom.catalog.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = pair
    return out
