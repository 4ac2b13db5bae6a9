"""Loads every query module and exposes the registry."""

from __future__ import annotations

import importlib
import pkgutil

from sightline import plans
from sightline.plans import registry


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"sightline.plans.{module}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
