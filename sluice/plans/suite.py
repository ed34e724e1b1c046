"""All queries of the suite and their oracles."""

from . import assets, enhancing, grouping, kernels, layouts, naming, outputs, pairing, planning, reporting, states, verifying  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
