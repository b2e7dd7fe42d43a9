"""All registered queries of the engine and their SQL twins."""

from . import chunks, decoding, readers, routing, runtime, snapshots, state, system  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
