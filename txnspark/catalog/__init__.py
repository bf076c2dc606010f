"""Every registered query with the SQL it is checked against."""

from txnspark.catalog import (  # noqa: F401  (importing registers the queries)
    evaluation,
    matrices,
    scalars,
    summaries,
    tables,
    windows,
)
from txnspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
