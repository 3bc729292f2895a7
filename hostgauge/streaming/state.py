"""Stateful operators over the event stream.

State is kept per (shard of keys, time bucket): a call works on all keys of a shard at
once, as a call per key costs far more than its rows, and a busy key is spread over its
buckets when a backlog is read. It lies in RocksDB, a batch's rows at a time:
a batch adds its rows to the list of its bucket and takes old ones out only when they
are the larger part. A bucket's state goes when the watermark passes the bucket's end,
by a timer in event time, whether its key is heard of again or not. Rows behind the
watermark do not reach these operators; ``start_ingest`` sets them apart before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostgauge.fixed_values import (
    ALERT_COUNT, ALERT_MIN_RATE, ALERT_MIN_SEVERITY, ALERT_WINDOW_S, FEATURE_WINDOW_S, SERVING_GAP_S,
)
from hostgauge.operators.filters import tracked_users
from hostgauge.operators.rolling import BUCKET_WINDOWS, with_halo
from hostgauge.schemas import PROCESS_KEY, USER_KEY

ROLLING_COLUMNS = ["syscall_rate_5s", "unique_syscalls_5s", "failed_call_ratio_5s", "inter_arrival_ms"]
SHARDS = 512  # of keys; state that a checkpoint holds is found by it, so it stays what it is
_MISSING = "_missing"
_ALONE = -(1 << 62)  # buckets below hold one row that has no time
DELAY = "30 minutes"  # how far behind the newest event a row may come
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# The clock of these operators starts 35 years early: the first watermark is the clock's zero, and a row
# at or before it counts as late.
_EARLY_US = 1 << 50


def _clock_ms(ts_us: int) -> int:
    return (ts_us + _EARLY_US) // 1000


def _watermark_us(timer_values) -> int:
    return timer_values.getCurrentWatermarkInMs() * 1000 - _EARLY_US


def _shard(keys: list[str]) -> Column:
    """Keys share the state of a shard, as a call per key costs more than the work. Null parts of keys make shards of their
    own, so that within a shard a part is null throughout or nowhere."""
    nulls = [F.when(F.col(k).isNull(), SHARDS << i).otherwise(0) for i, k in enumerate(keys)]
    return reduce(Column.__add__, nulls, F.pmod(F.xxhash64(*keys), F.lit(SHARDS)))


def _in_buckets(df: DataFrame, keys: list[str], reach_us: int, bucket_us: int, delay: str) -> DataFrame:
    """Rows per shard and time bucket (``shard``, ``time_bucket``, ``own_row``) with a watermark; the step's columns must not begin with "_"."""
    timed = df.withColumn("event_time", F.timestamp_micros(F.col("ts_us") + _EARLY_US)).withWatermark("event_time", delay)
    rows = with_halo(timed, reach_us, bucket_us).withColumnsRenamed({"_bucket": "time_bucket", "_own": "own_row"})
    return rows.withColumn("shard", _shard(keys))


def _without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 for null, and a flag beside it: whole numbers with nulls would go through pandas as floats."""
    flags = {c + _MISSING: F.col(c).isNull() for c in columns}
    return df.withColumns({**flags, **{c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in columns}})


def _packed(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(chunk)).read_pandas()


def _codes(keys: pd.DataFrame) -> np.ndarray:
    """Keys numbered in the order of their first rows; null equals null."""
    return keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy(np.int64)


def _tuples(rows: pd.DataFrame) -> Iterator[tuple]:
    """Rows as plain values, null as None."""
    return zip(*[[None if pd.isna(v) else v for v in rows[c].tolist()] for c in rows.columns])


def _since(values: np.ndarray, upto: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from ``first`` to ``upto``, both included."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[upto + 1] - running[first]


def rolling_values(ts: np.ndarray, event: np.ndarray, failed: np.ndarray, window: int, gap: int) -> dict[str, np.ndarray]:
    """The four rolling features of rows in time order."""
    here = np.arange(len(ts))
    first = np.searchsorted(ts, ts - window, side="left")
    by_event = pd.Series(ts).groupby(event)
    before, after = by_event.shift(1).to_numpy(), by_event.shift(-1).to_numpy()
    opens = ~(ts - before <= window)
    closes = ~(after - ts <= window)
    ids = np.cumsum(opens) - np.concatenate([[0], np.cumsum(closes)])[first]
    delay = np.diff(ts, prepend=ts[:1])
    rate = here - first + 1
    return {
        "syscall_rate_5s": rate.astype(float),
        "unique_syscalls_5s": ids.astype(float),
        "failed_call_ratio_5s": _since(failed, here, first) / rate,
        "inter_arrival_ms": np.where(delay <= gap, delay, 0) / 1000.0,
    }


class _Bucket(StatefulProcessor):
    """Rows of the keys of a (shard, bucket): key, ``ts``, ``seq`` and some more numbers each. They go when the bucket ends."""

    def __init__(self, keys: list[str], bucket_us: int, reach_us: int):
        self.keys, self.bucket_us, self.reach_us = keys, bucket_us, reach_us
        # rows of a bucket's key lie within bucket and reach, so that keys so far apart do not see each other
        self.apart_us = bucket_us + 2 * reach_us + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "chunk binary")

    def _closes_at(self, key: tuple) -> int:
        """When no row of the bucket can come any more, in milliseconds."""
        return _clock_ms((int(key[-1]) + 1) * self.bucket_us) + 1

    def _held(self) -> list[pd.DataFrame]:
        return [_unpacked(r[0]) for r in self.rows.get()]

    def _keep(self, key: tuple, held: list[pd.DataFrame], new: pd.DataFrame, oldest: int | None = None) -> None:
        """Adds ``new`` rows; rewrites the list without rows before ``oldest`` once these are the larger part."""
        if int(key[-1]) < _ALONE:
            return
        if not held:
            self.handle.registerTimer(self._closes_at(key))
        if oldest is not None:
            left = sum(int((part["ts"] >= oldest).sum()) for part in (*held, new))
            if 2 * left < sum(map(len, held)) + len(new):
                every = pd.concat([*held, new], ignore_index=True)
                self.rows.put([(_packed(every[every["ts"] >= oldest]),)]) if left else self.rows.clear()
                return
        self.rows.appendValue((_packed(new),))

    def _in_order(self, rows: pd.DataFrame, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows by key, time and arrival, and their times with the keys apart."""
        ts = rows["ts"].to_numpy(np.int64)
        order = np.lexsort((rows["seq"].to_numpy(np.int64), ts, code))
        return order, ts[order] + code[order] * self.apart_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Rolling(_Bucket):
    def __init__(self, keys: list[str], window: int, gap: int, bucket_us: int, kept: list[str]):
        super().__init__(keys, bucket_us, max(window, gap))
        self.window, self.gap, self.kept = window, gap, kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        added = new[self.keys].assign(
            ts=new["ts_us"], seq=new["seq"], event=np.where(new["eventId" + _MISSING], -1, new["eventId"]),
            failed=(new["returnValue"] < 0).astype(np.int64),
        )
        held = self._held()
        every = pd.concat([*held, added], ignore_index=True)
        order, ts = self._in_order(every, _codes(every[self.keys]))
        event, failed = (every[c].to_numpy(np.int64)[order] for c in ("event", "failed"))
        values = rolling_values(ts, event, failed, self.window, self.gap)
        self._keep(key, held, added, _watermark_us(timerValues) - self.reach_us)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_new = place[len(every) - len(added):]
        own = new["own_row"].to_numpy(bool)
        if own.any():
            yield new[self.kept].assign(**{c: v[of_new] for c, v in values.items()})[own]


def stream_rolling_features(
    events: DataFrame, window_s: float = FEATURE_WINDOW_S, gap_s: float = SERVING_GAP_S, keys: list[str] = PROCESS_KEY,
    bucket_windows: int = BUCKET_WINDOWS, delay: str = DELAY,
) -> DataFrame:
    """Streaming form of the serving features, next to the key and every column of ``events`` that is no text.

    Text stays outside: it would go through Python for nothing. ``delay`` is how far
    behind the newest event seen a row may come.
    """
    window, gap = int(window_s * 1_000_000), int(gap_s * 1_000_000)
    reach = max(window, gap)
    bucket_us = reach * bucket_windows
    kept = [f for f in events.schema if f.name in keys or not isinstance(f.dataType, T.StringType)]
    whole = [f.name for f in kept if isinstance(f.dataType, T.IntegralType) and f.name not in keys]
    flags = [T.StructField(c + _MISSING, T.BooleanType()) for c in whole]
    schema = T.StructType([*kept, *flags, *[T.StructField(c, T.DoubleType()) for c in ROLLING_COLUMNS]])
    names = [f.name for f in (*kept, *flags)]
    rows = _in_buckets(events.select(*[f.name for f in kept]), keys, reach, bucket_us, delay)
    found = _without_nulls(rows, whole).groupBy("shard", "time_bucket").transformWithStateInPandas(
        _Rolling(keys, window, gap, bucket_us, names), schema, "Append", "EventTime"
    )
    return found.withColumns({c: F.when(~F.col(c + _MISSING), F.col(c)) for c in whole}).drop(*[f.name for f in flags])


CROSSING_SCHEMA = "hostname string, user_id bigint, ts_us bigint, seq bigint, severity2_count bigint, total_count bigint"
_CROSSING_AT_SCHEMA = CROSSING_SCHEMA + ", bucket bigint, at timestamp"
REVISION_SCHEMA = CROSSING_SCHEMA + ", revision int"
_FOUND = ["ts", "seq", "high", "total"]
_NONE = -1  # sequence number of "no crossing"


class _Crossing(_Bucket):
    """Tells the first row of the bucket whose window passes both gates, for each user and whenever that changes.

    Any row may come late, so all rows of the bucket are held until it closes. Rows
    after crossings that are known need no look at the others.
    """

    def __init__(self, window: int, count: int, min_rate: float, min_severity: int, bucket_us: int):
        super().__init__(USER_KEY, bucket_us, window)
        self.window, self.count, self.min_rate, self.min_severity = window, count, min_rate, min_severity

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.found = handle.getValueState("found", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        hit = (new["severity"] >= self.min_severity).astype(np.int64)
        added = new[USER_KEY].assign(ts=new["ts_us"], seq=new["seq"], hit=hit)
        chunk = self.found.get()
        known = _unpacked(chunk[0]) if chunk is not None else added.iloc[:0]
        if len(known) and self._all_later(known, added):
            self.rows.appendValue((_packed(added),))
            return
        held = self._held()
        self._keep(key, held, added)
        every = pd.concat([*held, added], ignore_index=True)
        code = _codes(pd.concat([every[USER_KEY], known[USER_KEY]], ignore_index=True))
        code, of_known = code[: len(every)], code[len(every):]
        before, now = (np.tile(np.array([0, _NONE, 0, 0]), (code.max() + 1, 1)) for _ in range(2))
        if len(known):
            before[of_known] = known[_FOUND]
        self._first(every, code, int(key[-1]), now)
        changed = np.flatnonzero((now != before).any(axis=1))
        if not len(changed):
            return
        users = every[USER_KEY].iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
        some = np.flatnonzero(now[:, 1] != _NONE)
        if len(some):
            self.found.update((_packed(users.iloc[some].assign(**dict(zip(_FOUND, now[some].T)))),))
        else:
            self.found.clear()
        # not before any row of this batch, so that the next operator never takes it for late
        ts = added["ts"].to_numpy(np.int64)
        at = np.where(now[:, 1] == _NONE, ts.max(), np.maximum(now[:, 0], ts.min()))
        out = dict(zip(["ts_us", "seq", "severity2_count", "total_count"], now[changed].T))
        yield users.iloc[changed].assign(**out, bucket=int(key[-1]), at=pd.to_datetime(at[changed] + _EARLY_US, unit="us"))

    def _all_later(self, known: pd.DataFrame, added: pd.DataFrame) -> bool:
        code = _codes(pd.concat([known[USER_KEY], added[USER_KEY]], ignore_index=True))
        of_known, code = code[: len(known)], code[len(known):]
        if code.max() >= len(known):
            return False
        ts, seq = (known[c].to_numpy(np.int64)[np.argsort(of_known)][code] for c in ("ts", "seq"))
        return bool(((added["ts"] > ts) | ((added["ts"] == ts) & (added["seq"] > seq))).all())

    def _first(self, rows: pd.DataFrame, code: np.ndarray, bucket: int, now: np.ndarray) -> None:
        """Puts (ts, seq, high, total) of each user's first crossing into ``now``."""
        order, ts = self._in_order(rows, code)
        here = np.arange(len(order))
        since = np.searchsorted(ts, ts - self.window, side="left")
        high, total = _since(rows["hit"].to_numpy(np.int64)[order], here, since), here - since + 1
        at, seq, code = rows["ts"].to_numpy(np.int64)[order], rows["seq"].to_numpy(np.int64)[order], code[order]
        own = (at // self.bucket_us == bucket) | (bucket < _ALONE)
        crossed = np.flatnonzero(own & (high >= self.count) & (high / total >= self.min_rate))
        users, first = np.unique(code[crossed], return_index=True)
        i = crossed[first]
        now[users] = np.column_stack([at[i], seq[i], high[i], total[i]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.found.clear()
        return iter(())


class _Latch(StatefulProcessor):
    """One alert per user: the first crossing of the user's buckets, told again only if a late row changes it.

    Crossings of open buckets are held; once the bucket of the first one has closed,
    the alert is final, the rest goes, and the user costs one row from then on.
    """

    def __init__(self, bucket_us: int):
        self.bucket_us = bucket_us

    def _closes_at(self, bucket: int) -> int:
        return _clock_ms((bucket + 1) * self.bucket_us) + 1 if bucket > _ALONE else 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getValueState("buckets", "chunk binary")  # user, bucket and crossing
        self.told = handle.getValueState("told", "chunk binary")  # user, crossing, revision, final

    def _state(self) -> tuple[dict[tuple, dict[int, tuple]], dict[tuple, tuple]]:
        """By user: crossings by bucket; (ts, seq, high, total, revision, final)."""
        open_, told = {}, {}
        for name, state in (("open", self.buckets), ("told", self.told)):
            chunk = state.get()
            for user, more in () if chunk is None else ((r[:2], r[2:]) for r in _tuples(_unpacked(chunk[0]))):
                if name == "told":
                    told[user] = more
                else:
                    open_.setdefault(user, {})[more[0]] = more[1:]
        return open_, told

    def _store(self, open_: dict, told: dict) -> None:
        rows = [(*user, bucket, *v) for user, held in open_.items() for bucket, v in held.items()]
        for state, found, more in (
            (self.buckets, rows, ["bucket", *_FOUND]), (self.told, [(*user, *v) for user, v in told.items()], [*_FOUND, "revision", "final"]),
        ):
            if found:
                state.update((_packed(pd.DataFrame(found, columns=[*USER_KEY, *more])),))
            else:
                state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_, told = self._state()
        new: dict[tuple, list] = {}
        columns = [*USER_KEY, "bucket", "ts_us", "seq", "severity2_count", "total_count"]
        for r in _tuples(pd.concat(list(rows))[columns]):
            if r[:2] not in told or not told[r[:2]][5]:
                new.setdefault(r[:2], []).append(r[2:])
        if not new:
            return
        out, closing = [], set()
        for user, crossings in new.items():
            held = open_.setdefault(user, {})
            for bucket, ts, seq, high, total in crossings:
                if seq == _NONE:
                    held.pop(bucket, None)
                else:
                    held[bucket] = (ts, seq, high, total)
            first = min(((*v, b) for b, v in held.items()), default=None)
            now, before = first[:4] if first else (0, _NONE, 0, 0), told.get(user, (0, _NONE, 0, 0, 0, False))
            if now != before[:4]:
                told[user] = (*now, before[4] + 1, False)
                out.append((*user, *((None, None) if first is None else now[:2]), *now[2:], before[4] + 1))
            if first:
                closing.add(self._closes_at(first[4]))
        self._store(open_, told)
        for at in closing:
            self.handle.registerTimer(at)
        if out:
            found = pd.DataFrame(out, columns=[f.split(" ")[0] for f in REVISION_SCHEMA.split(", ")], dtype=object)
            yield found.astype({"ts_us": "Int64", "seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Buckets of first crossings have closed: where such a crossing still is the first, it stays so."""
        open_, told = self._state()
        for user, held in list(open_.items()):
            first = min(((*v, b) for b, v in held.items()), default=None)
            if first is not None and self._closes_at(first[4]) <= timerValues.getCurrentWatermarkInMs():
                told[user] = (*told[user][:5], True)
                del open_[user]
        self._store(open_, told)
        return iter(())

    def close(self) -> None:
        pass


def stream_crossings(
    scored: DataFrame,
    window_s: float = ALERT_WINDOW_S,
    count: int = ALERT_COUNT,
    min_rate: float = ALERT_MIN_RATE,
    min_severity: int = ALERT_MIN_SEVERITY,
    untracked: list[int] | None = None,
    bucket_windows: int = BUCKET_WINDOWS,
    delay: str = DELAY,
) -> DataFrame:
    """The first row of each (user, ``bucket``) whose window passes both gates, and again whenever a late row changes it."""
    window = int(window_s * 1_000_000)
    bucket_us = window * bucket_windows
    rows = tracked_users(scored, "user_id", untracked).select(*USER_KEY, "ts_us", "seq", "severity")
    rows = _without_nulls(_in_buckets(rows, USER_KEY, window, bucket_us, delay), ["ts_us"])
    return rows.groupBy("shard", "time_bucket").transformWithStateInPandas(
        _Crossing(window, count, min_rate, min_severity, bucket_us), _CROSSING_AT_SCHEMA, "Append", "EventTime",
        eventTimeColumnName="at",
    )


def stream_alert_revisions(scored: DataFrame, window_s: float = ALERT_WINDOW_S, bucket_windows: int = BUCKET_WINDOWS, **gates) -> DataFrame:
    """``REVISION_SCHEMA``: each user's first crossing (revision 1), and corrections of it by late rows (2, 3, ...;
    without time if nothing is left of it). State per user is what is open, not what was told before."""
    crossings = stream_crossings(scored, window_s, bucket_windows=bucket_windows, **gates)
    return crossings.withColumn("shard", _shard(USER_KEY)).groupBy("shard").transformWithStateInPandas(
        _Latch(int(window_s * 1_000_000) * bucket_windows), REVISION_SCHEMA, "Append", "EventTime"
    )


def stream_activity(events: DataFrame, delay: str = "2 minutes", length: str = "60 seconds") -> DataFrame:
    """Events per host and minute of event time; run it in update mode."""
    return (
        events.withColumn("ts", F.timestamp_micros("ts_us"))
        .withWatermark("ts", delay)
        .groupBy("hostName", F.window("ts", length))
        .agg(F.count(F.lit(1)).alias("events_per_min"), F.max("ts").alias("last_seen"))
        .select(F.col("hostName").alias("hostname"), "window", "events_per_min", "last_seen")
    )
