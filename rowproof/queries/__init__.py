"""The engine's queries over the standard tables: the engine's plan on one side, plain DuckDB SQL on the other."""

from . import documents, evaluation, more, repairs, verification
from .base import ORACLES, QUERIES
from .verification import flagship


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


__all__ = ["documents", "evaluation", "flagship", "more", "oracle_sql", "queries", "repairs", "verification"]
