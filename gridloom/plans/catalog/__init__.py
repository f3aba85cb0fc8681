"""All registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "sources",
    "time_steps",
    "grids",
    "features",
    "alignment",
    "aggregation",
    "verification",
    "ensembles",
    "corrections",
    "splits",
    "learning",
    "regions",
]


def load(areas: list[str] | None = None):
    """Import the areas and return (queries, sql)."""
    for area in areas or AREAS:
        import_module(f"{__name__}.{area}")
    base = import_module(f"{__name__}.base")
    return base.QUERIES, base.SQL
