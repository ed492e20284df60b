"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["profiles", "rule_checks", "relations", "statistics", "calculations", "governing", "lifecycle"]


def suites():
    return [import_module(f"lensdq.queries.{m}").suite for m in MODULES]


def queries():
    return {name: run for s in suites() for name, run in s.queries().items()}


def oracle_sql():
    return {name: sql for s in suites() for name, sql in s.statements.items()}
