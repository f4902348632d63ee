"""Shared-storage helpers of the library, under the names used here."""

from __future__ import annotations

from ..operators.components import connected_components
from ..storage import discard, materialise, n_partitions, shared_dir, table

__all__ = ["connected_components", "discard", "materialise", "n_partitions", "shared_dir", "table"]
