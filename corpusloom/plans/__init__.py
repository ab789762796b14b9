"""Query catalogue."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every catalogue module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{module.name}")
