"""Every registered query: importing the modules registers them."""

from __future__ import annotations

from importlib import import_module

from tidemark.plans import registry

MODULES = ("tables", "profiles", "explorations", "cleanings", "calendars", "pits", "featured", "predictions", "documents")


def _load() -> None:
    for m in MODULES:
        import_module(f"tidemark.plans.{m}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
