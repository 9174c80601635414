"""All registered queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("compare_checks", "score_checks", "retrieve_checks", "text_checks", "curate_checks", "source_checks")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"sqlverdict.plans.{family}"), attribute))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
