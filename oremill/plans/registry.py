"""Queries of the reference's operators by name, and their SQL."""

from . import models, tables  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
