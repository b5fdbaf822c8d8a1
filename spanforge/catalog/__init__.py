"""The engine's queries, by name."""

from . import distribution, frames, resources, sampling, sources, zones  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
