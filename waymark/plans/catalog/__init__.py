"""All registered queries: what the driver runs and checks."""

from waymark.plans.catalog import jobs, ranking, scalars, tables  # noqa: F401
from waymark.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
