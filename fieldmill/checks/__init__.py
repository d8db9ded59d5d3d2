"""Checked queries by inventory id."""

from importlib import import_module

from .base import REGISTRY, Check

MODULES = ("sources", "pages", "rules", "texts", "retrieval", "sessions", "reports", "scores")


def all_checks() -> dict[str, Check]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
