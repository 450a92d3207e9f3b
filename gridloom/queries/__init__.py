"""Registered queries over the shared tables, with the SQL each must agree with."""

from . import catalog, features, logs, masks, metrics, models, objects, scalars, sources, space, streams  # noqa: F401
from .data import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
