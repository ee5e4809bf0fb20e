"""Connected components; kept here under the name that the operators import."""

from __future__ import annotations

from stemtally.functions.components import connected_components

__all__ = ["connected_components"]
