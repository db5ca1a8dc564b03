"""Spark-native analytics for execution traces and hardware design-space studies."""

from tracemill.session import cut_lineage, get_session

__all__ = ["cut_lineage", "get_session"]
