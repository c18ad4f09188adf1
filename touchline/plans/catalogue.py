"""All registered queries."""

from touchline.plans import decisions, definitions, extras, forecasting, standings, tables  # noqa: F401  registers
from touchline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
