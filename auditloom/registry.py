"""Every query of the library by name, and the SQL that checks it."""

from __future__ import annotations

from .queries import chunking, detection, evaluation, findings, streams, text, work
from .queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunking", "detection", "evaluation", "findings", "streams", "text", "work"]
