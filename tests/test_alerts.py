"""The tracker's rules, and the latch against a one-by-one simulation."""

import numpy as np
import pytest

from hostgauge.operators import alerts as al

GATES = {"count": 3, "window_s": 60, "min_rate": 0.30}


def feed(spark, *runs, host="host-a", uid=1500):
    """Rows of ``(how many, severity)`` runs, one millisecond apart."""
    severities = [s for n, s in runs for _ in range(n)]
    rows = [(host, uid, i * 1000, i, s) for i, s in enumerate(severities)]
    return spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")


def test_below_threshold(spark):
    assert al.alerts(feed(spark, (2, 2)), **GATES).count() == 0


def test_both_gates(spark):
    found = al.alerts(feed(spark, (3, 2)), **GATES).collect()
    assert len(found) == 1
    assert (found[0]["hostname"], found[0]["user_id"]) == ("host-a", 1500)
    assert "sev2=3/3" in found[0]["trigger"]


def test_rate_gate(spark):
    assert al.alerts(feed(spark, (20, 0), (3, 2)), **GATES).count() == 0


def test_never_tracked(spark):
    scored = feed(spark, (5, 2), uid=0)
    assert al.alerts(scored, **GATES).count() == 0
    assert al.user_states(scored, **GATES).count() == 0
    assert al.alerts(feed(spark, (5, 2), uid=2000), **GATES, untracked=[2000]).count() == 0


def test_one_alert_per_user(spark):
    assert al.alerts(feed(spark, (3, 2), (5, 2)), **GATES).count() == 1


def test_rate_exactly_at_the_gate(spark):
    assert al.alerts(feed(spark, (7, 0), (3, 2)), **GATES).count() == 1


def test_window_includes_its_lower_end(spark):
    def at(*times):
        rows = [("h", 1500, t, i, 2) for i, t in enumerate(times)]
        return spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")

    assert al.alerts(at(0, 1, 60_000_000), **GATES).count() == 1
    assert al.alerts(at(0, 1, 60_000_001), **GATES).count() == 0


def test_old_benign_events_leave_and_raise_the_rate(spark):
    rows = [("h", 1500, i * 1000, i, 0) for i in range(20)] + [("h", 1500, 70_000_000 + i, 20 + i, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")
    assert [r["trigger"] for r in al.alerts(df, **GATES).collect()] == ["rate+threshold (sev2=3/3=100%)"]


def test_count_only_rule_ignores_the_rate(spark):
    found = al.count_only_alerts(feed(spark, (20, 0), (3, 2)), 60, 3).collect()
    assert [(r["seq"], r["severity2_count"]) for r in found] == [(22, 3)]


def simulate(rows, count, window_us, min_rate):
    """Events one by one, with the latch kept per user."""
    held, fired, last = {}, {}, {}
    for host, uid, t, seq, sev in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (host, uid)
        if key in fired:
            continue
        win = [(u, s) for u, s in held.get(key, []) if u >= t - window_us] + [(t, sev)]
        held[key] = win
        high = sum(s >= 2 for _, s in win)
        last[key] = (high, len(win))
        if high >= count and high / len(win) >= min_rate:
            fired[key] = (t, seq, high, len(win))
    return fired, last


@pytest.mark.parametrize("seed,rate", [(1, 0.30), (2, 0.2), (3, 0.45)])
def test_equals_simulation(spark, seed, rate):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1500):
        uid = 1500 if rng.random() < 0.4 else 1501 + int(rng.integers(6))
        rows.append(("h", uid, int(rng.integers(0, 2500)) * 1_000_000, i, int(rng.choice([0, 1, 2], p=[0.75, 0.15, 0.1]))))
    df = spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int").repartition(6)
    fired, last = simulate(rows, 5, 60_000_000, rate)
    got = {(r["hostname"], r["user_id"]): (r["ts_us"], r["seq"], r["severity2_count"], r["total_count"]) for r in al.alerts(df, min_rate=rate).collect()}
    assert got == fired
    states = al.user_states(df, min_rate=rate).collect()
    assert {(r["hostname"], r["user_id"]): (r["severity2_count"], r["total_count"]) for r in states} == last
    assert {(r["hostname"], r["user_id"]) for r in states if r["alerted"]} == set(fired)


def test_history(spark):
    automatic = al.alerts(feed(spark, (3, 2)), **GATES)
    manual = spark.createDataFrame([(5_000_000, "host-a", 7), (6_000_000, "elsewhere", 8)], "ts_us bigint, hostname string, user_id bigint")
    hosts = spark.createDataFrame([("host-a",)], "hostname string")
    rows = al.newest_first(al.alert_history(automatic, manual, hosts)).collect()
    assert [(r["user_id"], r["trigger"].split()[0]) for r in rows] == [(7, "manual"), (1500, "rate+threshold")]
