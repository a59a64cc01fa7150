"""Registered queries, one module per area."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    for m in iter_modules(__path__):
        if m.name.startswith("q_"):
            import_module(f"{__name__}.{m.name}")
