"""Registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil

from lakeops.plans.registry import REGISTRY, Query

SKIP = {"registry"}


def load_all() -> dict[str, Query]:
    """Import every module of this package, which fills the registry."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda i: i.name):
        if info.name not in SKIP:
            importlib.import_module(f"{__name__}.{info.name}")
    return REGISTRY
