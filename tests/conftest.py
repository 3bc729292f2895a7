import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hostgauge.session import build_session

    s = build_session(
        "hostgauge-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


EVENT = {
    "timestamp": 1.0, "processId": 1234, "threadId": 1234, "parentProcessId": 1, "userId": 1500,
    "mountNamespace": 4026531840, "processName": "bash", "hostName": "test-host", "eventId": 59,
    "eventName": "execve", "stackAddresses": "[]", "argsNum": 2, "returnValue": 0, "args": "[]", "sus": 0, "evil": 0,
}


def events(spark, rows):
    """Event table from partial dicts over a default event; adds ts_us and seq."""
    from hostgauge.schemas import EVENT_SCHEMA, with_clock
    from pyspark.sql import types as T

    schema = T.StructType([*EVENT_SCHEMA, T.StructField("seq", T.LongType())])
    full = [{**EVENT, "seq": i, **r} for i, r in enumerate(rows)]
    return with_clock(spark.createDataFrame([tuple(r[f] for f in schema.names) for r in full], schema))
