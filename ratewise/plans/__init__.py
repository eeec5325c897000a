"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["scores", "agreements", "repeats", "boards", "costs", "labels", "checks", "texts", "catalogs", "files", "streams"]


def load_registry():
    from ratewise.plans.registry import REGISTRY

    for name in MODULES:
        import_module(f"ratewise.plans.{name}")
    return REGISTRY
