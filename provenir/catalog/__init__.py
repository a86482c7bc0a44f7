"""Registered queries, each with equivalent SQL where it can be expressed."""

from . import evaluation, features, fusion, live, series, stores, text, unified  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
