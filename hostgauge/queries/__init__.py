"""Named queries over the given tables and, where SQL can say it, the same in SQL."""

from hostgauge.queries import alerting, evaluation, facts, features, ingest, models, monitoring, statistics, stream_tables, streams  # noqa: F401
from hostgauge.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
