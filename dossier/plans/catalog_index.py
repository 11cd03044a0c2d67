"""Loads every catalog module; importing this fills the registry."""

import importlib
import pkgutil

from dossier.plans import catalog
from dossier.plans.catalog.base import ORACLES, QUERIES

for module in pkgutil.iter_modules(catalog.__path__):
    importlib.import_module(f"{catalog.__name__}.{module.name}")

__all__ = ["ORACLES", "QUERIES"]
