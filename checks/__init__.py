"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("contracts", "facts", "rules", "logs", "streams", "personal", "workload", "diffs", "findings", "scores", "pages", "money", "access")


def registries():
    return [import_module(f"checks.{name}").REGISTRY for name in MODULES]
