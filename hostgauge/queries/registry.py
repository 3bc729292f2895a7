"""Registration of queries, and the SQL of what several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY_S = 86_400
DAY_US = DAY_S * 1_000_000
WEEK_S = 7 * DAY_S
WEEK_US = 7 * DAY_US


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def as_int(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# The event table the way ``sources.tables.telemetry`` reads it.
T = """
raw AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id AS u, event_type AS et, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
t AS (
  SELECT seq, ts_us, ts_us / 1000000 AS "timestamp",
         u * 10 + k % 2 AS processId,
         u * 10 + k % 2 + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END AS threadId,
         u AS parentProcessId, u AS userId, 4026531840 + u % 6 AS mountNamespace,
         (['bash','python3','id','nmap','curl','sudo','sshd','snapd'])[k % 8 + 1] AS processName,
         'host-' || (u % 7) AS hostName,
         CASE et WHEN 'click' THEN 257 WHEN 'view' THEN 3 WHEN 'purchase' THEN 42 WHEN 'error' THEN 59 ELSE 1000 END AS eventId,
         CASE et WHEN 'click' THEN 'openat' WHEN 'view' THEN 'close' WHEN 'purchase' THEN 'connect'
                 WHEN 'error' THEN 'execve' ELSE 'security_file_open' END AS eventName,
         k % 5 AS argsNum,
         CASE WHEN et = 'error' THEN -13 ELSE CAST(floor(value) AS BIGINT) END AS returnValue,
         (['/etc/shadow','/home/u/.aws/credentials','../../x','ls | wc','http://10.0.0.1/a','/tmp/a'])[k % 6 + 1] AS arg,
         CASE WHEN et = 'error' THEN 1 ELSE 0 END AS sus,
         CASE WHEN et = 'error' AND value > 20 THEN 1 ELSE 0 END AS evil,
         value, k
  FROM raw
)"""

# ... with the score that needs no forest, and its entity.
S = T + """,
s AS (
  SELECT *, 0.2::DOUBLE - value / 500 - CASE WHEN sus = 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score,
         hostName || ':' || userId AS entity
  FROM t
)"""


def graded_sql(low: float, high: float, entity: str = "entity") -> str:
    """``g``: rows with thresholds by ``entity`` and severity."""
    return S + f""",
th AS (
  SELECT {entity} AS ent, quantile_cont(score, {low / 100}) AS low, quantile_cont(score, {high / 100}) AS high
  FROM s GROUP BY 1
),
g AS (
  SELECT s.*, th.low, th.high,
         CASE WHEN score < th.high THEN 2 WHEN score < th.low THEN 1 ELSE 0 END AS severity
  FROM s JOIN th ON s.{entity} = th.ent
)"""
