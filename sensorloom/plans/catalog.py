"""Loads every query module, so that the registry is complete."""

from sensorloom.plans import aggregates, live_streams, models, ordered, rules, scans, statistics  # noqa: F401
from sensorloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
