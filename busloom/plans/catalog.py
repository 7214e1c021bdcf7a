"""All named queries and their oracles."""

from __future__ import annotations

import importlib
import pkgutil

from busloom import plans
from busloom.plans.registry import ORACLES, QUERIES


def _load():
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"busloom.plans.{m.name}")


def queries():
    _load()
    return dict(sorted(QUERIES.items()))


def oracles():
    _load()
    return dict(sorted(ORACLES.items()))
