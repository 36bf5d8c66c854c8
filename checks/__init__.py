"""Registered queries and the SQL each of them is checked against."""

from importlib import import_module

FAMILIES = ["text", "chunking", "vectors", "retrieval", "lifecycle", "chat", "evaluate", "sets", "streams"]


def collect() -> tuple[dict, dict]:
    """All queries and all oracle texts of the check modules."""
    queries, oracles = {}, {}
    for name in FAMILIES:
        module = import_module(f"checks.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
