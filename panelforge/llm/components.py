"""Connected components of an edge table: the library's own star contraction, in DataFrame operations only, each round in the shared folder."""

from __future__ import annotations

from panelforge.operators.graph import connected as connected_components

__all__ = ["connected_components"]
