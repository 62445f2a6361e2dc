"""Every registered query and its SQL."""

from .plans import oracles, oracles_io
from .plans.queries import queries


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | oracles_io.oracle_sql()


__all__ = ["oracle_sql", "queries"]
