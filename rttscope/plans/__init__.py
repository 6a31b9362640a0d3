"""Fixed job sequences and the query catalog."""

from importlib import import_module

_MODULES = ("core", "eval", "select", "drift", "prod", "checks", "io", "ml", "stream")


def load_catalog():
    """Import every query module once and return the filled catalog."""
    for name in _MODULES:
        import_module(f"rttscope.plans.queries_{name}")
    return import_module("rttscope.plans.catalog")
