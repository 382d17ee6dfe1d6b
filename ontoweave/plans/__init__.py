"""Queries of the library bound to the driver's tables; importing this registers them."""

from . import bridges, budgets, entities, extensions, files, graphs, lookups, phrases, rankings, records, relational, snapshots, tables, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
