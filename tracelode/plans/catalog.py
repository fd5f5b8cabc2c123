"""All registered queries of the engine and their SQL."""

from . import more  # noqa: F401 - it registers its queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
