"""The query catalogue: each key with its Spark plan and its SQL."""

from . import corpora, documents, observations, results, scalars, states  # noqa: F401
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
