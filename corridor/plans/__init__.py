"""Query modules: each registers its queries when imported."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("statistics", "networks", "projections", "reports", "spatial", "files", "travel", "bundles", "audits", "ways")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"corridor.plans.{name}")
