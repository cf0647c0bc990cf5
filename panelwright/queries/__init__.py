from panelwright.queries.base import ORACLES, QUERIES
from panelwright.queries import (  # noqa: F401
    detection, extensions, policies, prepare, segmenting, streams, summaries, testing)

__all__ = ["ORACLES", "QUERIES"]
