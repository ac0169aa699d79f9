"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("relational", "aggregates", "scalars", "collections", "platform", "frames", "surface")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
