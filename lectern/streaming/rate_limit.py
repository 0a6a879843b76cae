"""A sliding-window limiter: what it rejects does not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "key string, id long, allowed boolean, retry_after int"


def decide(times: list[float], ids: list[int], kept: deque[float], limit: int, window: float) -> list[tuple[int, bool, int]]:
    """(id, allowed, seconds to wait) of requests in order of time; ``kept`` holds the accepted ones."""
    out = []
    for at, i in sorted(zip(times, ids)):
        while kept and kept[0] < at - window:
            kept.popleft()
        if len(kept) >= limit:
            out.append((i, False, max(int(kept[0] + window - at), 1)))
        else:
            kept.append(at)
            out.append((i, True, 0))
    return out


def decide_batch(rows: DataFrame, limit: int, window: float) -> DataFrame:
    """Decisions for (key, id, at), the requests of each key in order of time and id.

    Rows of one key are read in sorted order, batch by batch, with the accepted times of one window as
    the only state, so that a key may hold any number of rows.  Rows without a key or time are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for pdf in batches:
            out = []
            for k, i, at in zip(pdf["key"], pdf["id"], pdf["at"]):
                if k != key:
                    key, kept = k, deque()
                out += [(k, *x) for x in decide([at], [i], kept, limit, window)]
            yield pd.DataFrame(out, columns=["key", "id", "allowed", "retry_after"])

    rows = rows.select("key", "id", "at").dropna(subset=["key", "at"])
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, DECISIONS)


def decide_stream(rows: DataFrame, limit: int, window: float, watermark: str = "10 minutes") -> DataFrame:
    """The same for a stream of (key, id, ts): the accepted times of each key are its state.

    Requests of one micro-batch are taken in order of time; state goes when a window has passed
    without a request.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames))
        out = decide([t.timestamp() for t in pdf["ts"]], pdf["id"].tolist(), kept, limit, window)
        state.update((list(kept),))
        end = int((max(kept) + window) * 1000) if kept else 0
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "id", "allowed", "retry_after"])

    grouped = rows.withWatermark("ts", watermark).groupBy("key")
    return grouped.applyInPandasWithState(step, DECISIONS, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
