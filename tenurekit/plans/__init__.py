"""Registered queries over the driver's tables, each with equivalent SQL for a second engine."""

import importlib
import pkgutil


def load() -> None:
    """Import every plan module, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{m.name}")
