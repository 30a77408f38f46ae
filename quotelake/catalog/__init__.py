"""Named queries over the driver tables and the SQL each of them is checked against."""

from . import bindings
from .bindings import ORACLE, QUERIES
from . import text_queries, lookup_queries, detection_queries, label_queries, live_queries, stream_queries  # noqa: F401,E402

__all__ = ["ORACLE", "QUERIES", "bindings"]
