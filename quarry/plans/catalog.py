"""All queries of the retrieval and array engine, with their SQL."""

from quarry.plans import arrays, memory, proofs, records, retrieval, storage  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
