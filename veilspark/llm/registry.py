"""All queries of the text operators, by name, with their SQL counterparts."""

from importlib import import_module
from pkgutil import iter_modules

import veilspark.llm as here

MODULES = [import_module(f"veilspark.llm.{m.name}") for m in sorted(iter_modules(here.__path__), key=lambda m: m.name) if m.name.startswith("q")]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
