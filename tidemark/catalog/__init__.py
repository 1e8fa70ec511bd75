"""Named queries over the test tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    from tidemark.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"tidemark.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
