"""Every query of the engine by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import geometry, imaging, indexing, pairs

ALL = {**geometry.QUERIES, **indexing.QUERIES, **imaging.QUERIES, **pairs.QUERIES}
QUERIES = {name: f for name, (f, _) in ALL.items()}
SQL = {name: s for name, (_, s) in ALL.items() if s}
