"""All query families in one place."""

from __future__ import annotations

from . import associations, distributions, ingest, preparation, profiles

FAMILIES = [ingest, profiles, distributions, associations, preparation]


def queries() -> dict:
    return {name: make for family in FAMILIES for name, make in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
