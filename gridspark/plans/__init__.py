"""Registered queries: each applies library operators to tables or derived views."""

from . import queries_decode, queries_learn, queries_retrieval, queries_signal, queries_sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
