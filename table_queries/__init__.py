"""Every operator run over the driver's tables, each with the SQL it must agree with where SQL can say it."""

from table_queries.base import ORACLES, QUERIES
from table_queries import (  # noqa: F401  (imports register the queries)
    aggregates,
    gates,
    joins,
    plans,
    ranking,
    scalars,
    sequences,
    sources,
    streams,
)

__all__ = ["ORACLES", "QUERIES"]
