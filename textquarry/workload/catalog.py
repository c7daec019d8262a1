"""All registered queries and their SQL."""

from textquarry.workload import (  # noqa: F401
    q_chunks,
    q_files,
    q_index,
    q_projects,
    q_search,
)
from textquarry.workload.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
