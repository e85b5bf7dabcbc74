"""Queries over the given tables, one module per area of the engine."""

from importlib import import_module

AREAS = ["crawl", "listings", "content", "rules", "browse", "matching", "lifecycle", "streams"]


def load_all() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        import_module(f"marquesina.plans.{area}")
