"""Registered queries and their SQL twins."""

from importlib import import_module

from riskloom.catalog.registry import ORACLE, QUERIES

MODULES = ("features", "evaluation", "texts", "storage", "models")


def load():
    for name in MODULES:
        import_module(f"riskloom.catalog.{name}")
    return QUERIES, ORACLE
