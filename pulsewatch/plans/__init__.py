"""Named plans over the driver's tables (one per inventory operator)."""

from __future__ import annotations

import importlib

from .registry import ORACLES, PLANS

_MODULES = ("core", "ingest", "alerting", "features", "scoring", "dashboards", "tables", "models", "streams", "serving")


def load_all():
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return PLANS, ORACLES
