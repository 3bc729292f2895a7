import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.operators.rolling import with_halo, with_rolling_features, with_serving_features, with_trailing_counts
from tests.conftest import events, plan_of

COLS = ["syscall_rate_5s", "unique_syscalls_5s", "failed_call_ratio_5s", "inter_arrival_ms"]


def expected(rows, window=5_000_000, gap=None):
    """One pass over each process, the definition written out."""
    out = {}
    for key in {(r["hostName"], r["userId"], r["processId"]) for r in rows}:
        seen = []
        mine = sorted((r for r in rows if (r["hostName"], r["userId"], r["processId"]) == key), key=lambda r: (r["us"], r["seq"]))
        for r in mine:
            prev = seen[-1]["us"] if seen else r["us"]
            seen.append(r)
            frame = [s for s in seen if s["us"] >= r["us"] - window]
            delay = r["us"] - prev
            if gap is not None and delay > gap:
                delay = 0
            out[r["seq"]] = (
                float(len(frame)), float(len({s["eventId"] for s in frame})),
                sum(s["returnValue"] < 0 for s in frame) / len(frame), delay / 1000.0,
            )
    return out


def random_rows(seed, n=500, spread=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # a third of the rows belongs to one process; times tie often
        hot = rng.random() < 0.4
        us = int(rng.integers(0, spread)) * 500_000
        rows.append({
            "seq": i, "us": us, "timestamp": us / 1e6, "hostName": "h" if hot else f"h{rng.integers(2)}",
            "userId": 1, "processId": 7 if hot else int(rng.integers(3)), "eventId": int(rng.integers(1, 5)),
            "returnValue": int(rng.integers(-1, 2)),
        })
    return rows


def as_events(spark, rows):
    return events(spark, [{k: v for k, v in r.items() if k != "us"} for r in rows])


def got(df):
    return {r["seq"]: tuple(r[c] for c in COLS) for r in df.select("seq", *COLS).collect()}


@pytest.mark.parametrize("seed,bucket_windows,parts", [(1, 12, 3), (2, 1, 7), (3, 2, 1), (2, None, 4)])
def test_training_features(spark, seed, bucket_windows, parts):
    rows = random_rows(seed, spread=[400, 4000, 60][seed - 1])
    df = as_events(spark, rows).repartition(parts, F.rand(seed))
    result = got(with_rolling_features(df, bucket_windows=bucket_windows))
    wanted = expected(rows)
    assert result.keys() == wanted.keys()
    for seq, w in wanted.items():
        assert result[seq] == pytest.approx(w), seq


def test_serving_gap(spark):
    rows = random_rows(4, 200, 20_000)
    result = got(with_serving_features(as_events(spark, rows)))
    for seq, w in expected(rows, gap=60_000_000).items():
        assert result[seq] == pytest.approx(w), seq


def test_frame_edges(spark):
    base = [{"timestamp": t, "seq": i, "eventId": e} for i, (t, e) in enumerate([(0.0, 1), (5.0, 2), (5.000001, 3), (5.000001, 3)])]
    r = got(with_rolling_features(events(spark, base)))
    assert [r[i][0] for i in range(4)] == [1, 2, 2, 3]
    assert [r[i][1] for i in range(4)] == [1, 2, 2, 2]


def test_single_row_and_missing_time(spark):
    df = events(spark, [{"timestamp": 3.0}, {"timestamp": None, "processId": 9}])
    r = got(with_rolling_features(df))
    assert r[0] == r[1] == (1.0, 1.0, 0.0, 0.0)


def test_defaults_without_time(spark):
    df = spark.createDataFrame([(1,)], "seq bigint")
    assert got(with_rolling_features(df)) == {1: (1.0, 1.0, 0.0, 0.0)}


def test_trailing_counts(spark):
    rows = random_rows(6)
    df = as_events(spark, rows).select("hostName", "ts_us", "seq", "returnValue")
    res = with_trailing_counts(df, ["hostName"], F.col("returnValue") < 0, 60, 1).collect()
    for r in res:
        x = next(q for q in rows if q["seq"] == r["seq"])
        frame = [
            y for y in rows if y["hostName"] == x["hostName"] and y["us"] >= x["us"] - 60_000_000
            and (y["us"], y["seq"]) <= (x["us"], x["seq"])
        ]
        assert (r["total_count"], r["match_count"]) == (len(frame), sum(y["returnValue"] < 0 for y in frame))
    assert len(res) == len(rows)


def test_one_exchange_for_all_windows(spark):
    df = as_events(spark, random_rows(1))
    plan = plan_of(with_serving_features(df))
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_key_is_spread_over_tasks(spark):
    """One process with every row: its windows run in many groups, each short."""
    n = 6000
    hot = spark.range(n).select((F.col("id") * 1_000_000).alias("ts_us"), F.col("id").alias("seq"))
    groups = with_halo(hot, 5_000_000, 60_000_000).groupBy("_bucket").count()
    sizes = [r["count"] for r in groups.collect()]
    assert len(sizes) == n / 60 + 1 and max(sizes) <= 66
    copies = sum(sizes) / n
    assert copies < 1.1
