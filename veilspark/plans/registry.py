"""All queries of the core, by name, with their SQL counterparts."""

from __future__ import annotations

from veilspark.plans import curation, flagship, redaction

MODULES = [flagship, redaction, curation]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
