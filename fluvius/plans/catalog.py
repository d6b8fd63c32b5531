"""Query catalogue: name -> callable, name -> oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "answers", "texts", "graphs", "sequences", "spatial", "simulation", "documents", "rules", "overlays", "traces", "networks", "streams")

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    _m = import_module(f"{__package__}.{_name}")
    if _clash := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"two queries have one name: {sorted(_clash)}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
