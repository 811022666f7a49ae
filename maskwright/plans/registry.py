"""All queries by name."""

from maskwright.plans.queries import QUERIES

__all__ = ["QUERIES"]
