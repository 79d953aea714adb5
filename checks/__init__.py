"""Named queries over the provided tables, each with an independent SQL statement of its result."""

import importlib
import pkgutil


def load_all() -> None:
    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
