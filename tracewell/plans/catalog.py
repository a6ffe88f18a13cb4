"""All registered queries and their SQL."""

from . import capture_queries, more_queries  # noqa: F401
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
