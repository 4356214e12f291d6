"""All registered queries."""

from courtline.catalog import ingesting, joining, modelling, rating, shaping, storing  # noqa: F401
from courtline.catalog.registry import QUERIES

__all__ = ["QUERIES"]
