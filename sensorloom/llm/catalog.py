"""Loads every corpus query, so that the registry is complete."""

from sensorloom.llm import centroids, chat, decontaminate, fingerprints, jaccard, language, mixing, pii, quality, secrets, suffix_tree, toxicity, whitening  # noqa: F401
from sensorloom.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
