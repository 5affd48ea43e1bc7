"""Query plans of the operators; load() registers them."""

import importlib
import pkgutil


def load() -> None:
    """Import every module of plans here, which registers its queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
