"""Registry of the engine's own queries and their SQL."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
