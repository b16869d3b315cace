"""Operators of a training-data pipeline. Nothing else in the library imports
this package; ``__spark_entry__`` adds its queries when it is there."""

from . import queries  # noqa: F401 - importing the module registers the queries
from .registry import QUERIES

__all__ = ["QUERIES"]
