"""All registered queries; importing this module registers them."""

from . import analytics, scalar, search  # noqa: F401
from .registry import OPERATORS, ORACLE_SQL, QUERIES

__all__ = ["OPERATORS", "ORACLE_SQL", "QUERIES"]
