"""Composed jobs and the registered queries with their SQL oracles."""
from importlib import import_module

MODULES = ["queries_survey", "queries_tracks", "queries_products", "queries_grids", "queries_sources", "queries_learn"]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
