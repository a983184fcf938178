"""Rate limits with a bounded table of keys, as an ordered fold over a log and as a stream with timers.

A bucket counts failed attempts by key.  A window begins at a key's first failure; within it, attempts from the
``limit``-th failure on are blocked and change nothing; a success clears the key.  A bucket holds at most ``cap`` windows:
while it is full of windows that have not ended, failures of further keys are not counted, so that a flood of new keys
does not push out those that are blocked.

Defined cases: an attempt whose key or time is null is neither blocked nor counted; a null outcome is a failure; attempts
of one time go by their id; an empty log gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMIT, WINDOW_S, CAP = 10, 60, 8192
OUTPUT = "bucket string, id long, blocked boolean, counted boolean"


class Windows:
    """The windows of a bucket, in the order of their ends, as all are of one length and attempts come in order."""

    def __init__(self, limit: int, window_s: int, cap: int, held: dict | None = None):
        self.limit, self.window_s, self.cap = limit, window_s, cap
        self.held: dict[str, tuple[int, int]] = dict(sorted((held or {}).items(), key=lambda x: x[1][1]))

    def _end_before(self, at: int) -> None:
        while self.held and (first := next(iter(self.held)), self.held[first][1])[1] <= at:
            del self.held[first]

    def attempt(self, key: str | None, at: int | None, ok: bool | None) -> tuple[bool, bool]:
        """Whether the attempt is blocked, and whether it was counted as a failure."""
        if key is None or at is None:
            return False, False
        self._end_before(at)
        n, until = self.held.get(key, (0, at + self.window_s))
        if n >= self.limit:
            return True, False
        if ok:
            self.held.pop(key, None)
            return False, False
        if not n and len(self.held) >= self.cap:
            return False, False
        self.held[key] = (n + 1, until)
        return False, True


def capped_limits(attempts: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, cap: int = CAP) -> DataFrame:
    """``bucket, id, blocked, counted`` for a log of (bucket, id, key, at in seconds, ok).

    A bucket's attempts pass one task in batches, as its cap makes each depend on all before it; what is held is
    ``cap`` windows.  A log with few large buckets is dealt by making the bucket finer, a cap for each.
    """
    rows = attempts.select("bucket", "id", F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), "ok")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = object(), None
        for batch in batches:
            out = []
            for bucket, key, at, ok in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "at", "ok"))):
                if bucket != last:
                    last, windows = bucket, Windows(limit, window_s, cap)
                out.append(windows.attempt(key, at, ok))
            flags = [pa.array([x[i] for x in out], pa.bool_()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("id"), *flags], names=["bucket", "id", "blocked", "counted"])

    return rows.mapInArrow(fold, OUTPUT)


class _Limiter(StatefulProcessor):
    """A bucket's windows as a map in the state store; timers put out those that have ended."""

    def __init__(self, limit: int, window_s: int, cap: int):
        self.limit, self.window_s, self.cap = limit, window_s, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "key string", "n int, until long")

    def _held(self) -> dict:
        return {k[0]: (v[0], v[1]) for k, v in self.windows.iterator()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        before = self._held()
        windows = Windows(self.limit, self.window_s, self.cap, before)
        none = lambda x: None if pd.isna(x) else x
        out = [windows.attempt(none(k), None if pd.isna(at) else int(at), none(ok)) for k, at, ok in zip(f["key"], f["at"], f["ok"])]
        for k in before.keys() - windows.held.keys():
            self.windows.removeKey((k,))
        ends = set()
        for k, (n, until) in windows.held.items():
            if before.get(k) != (n, until):
                self.windows.updateValue((k,), (n, until))
                ends.add(until)
        for until in ends:
            self.handle.registerTimer(until * 1000)
        yield pd.DataFrame({"bucket": f["bucket"], "id": f["id"], "blocked": [b for b, _ in out], "counted": [c for _, c in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for k, (_, until) in self._held().items():
            if until <= ended:
                self.windows.removeKey((k,))
        return iter(())

    def close(self) -> None:
        pass


def capped_limits_stream(attempts: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, cap: int = CAP, late: str = "0 seconds") -> DataFrame:
    """The same over a stream; ``time`` is the attempt's time as a timestamp.

    Attempts count in the order of their times within a micro-batch, and of micro-batches among them; what comes later
    than ``late`` behind the newest time seen is dropped by the watermark.  Needs the RocksDB state store.  A micro-batch's
    attempts of a bucket are held by a task, so its size is to be bounded at the source.
    """
    rows = attempts.withWatermark("time", late)
    rows = rows.select("bucket", "id", F.col("key").cast("string").alias("key"), F.unix_seconds("time").alias("at"), "ok", "time")
    return rows.groupBy("bucket").transformWithStateInPandas(_Limiter(limit, window_s, cap), OUTPUT, "append", "EventTime")
