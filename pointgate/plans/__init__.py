"""Query plans bound to the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every plan module, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        if m.name != "registry":
            importlib.import_module(f"{__name__}.{m.name}")
