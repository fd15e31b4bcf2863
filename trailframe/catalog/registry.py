"""Loads every catalog module so that its queries register themselves."""

from __future__ import annotations

import importlib
import pkgutil

import trailframe.catalog as catalog
from trailframe.catalog.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    for module in pkgutil.iter_modules(catalog.__path__):
        if module.name not in ("base", "registry"):
            importlib.import_module(f"trailframe.catalog.{module.name}")
    return QUERIES, ORACLES
