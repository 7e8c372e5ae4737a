"""Sessions of a stream by own state and event-time timers: late order, merged sessions, late rows counted.

A user's open sessions are kept as state. An event joins the sessions within the gap of it, and may bring two together; a
timer at a session's end hands it out once the watermark has passed it, and then drops it. What lies behind the watermark of
the micro-batch before is dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id long, start_us long, last_us long, events long, value double"
_STATE = "start array<long>, last array<long>, n array<long>, total array<double>"


def add_events(sessions: list[list], times: list[int], values: list[float], gap: int) -> list[list]:
    """Sessions [first, last, events, sum] after some events in any order; neighbours less than gap apart are one."""
    out: list[list] = []
    for s in sorted([*sessions, *([t, t, 1, v] for t, v in zip(times, values, strict=True))], key=lambda s: s[0]):
        if out and s[0] < out[-1][1] + gap:
            out[-1] = [out[-1][0], max(out[-1][1], s[1]), out[-1][2] + s[2], out[-1][3] + s[3]]
        else:
            out.append(s)
    return out


def _step(gap: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = [list(s) for s in zip(*state.get, strict=True)] if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                sessions = add_events(sessions, f["us"].tolist(), f["value"].fillna(0.0).tolist(), gap)
        passed = state.getCurrentWatermarkMs()
        closed = [s for s in sessions if s[1] + gap <= passed * 1000]
        still = [s for s in sessions if s[1] + gap > passed * 1000]
        if still:
            state.update(tuple(list(c) for c in zip(*still, strict=True)))
            state.setTimeoutTimestamp(max(passed + 1, -(-(min(s[1] for s in still) + gap) // 1000)))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([(key[0], *s) for s in closed], columns=["user_id", "start_us", "last_us", "events", "value"])

    return run


def stream_sessions(events: DataFrame, gap_minutes: int = 30, late: str = "1 day") -> DataFrame:
    """user_id, session_start, last_event, events, value of a stream of events (user_id, ts, value), each when the watermark, the
    latest ts less `late`, has passed its end. Events without user or time are left out."""
    rows = events.where("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    out = rows.groupBy("user_id").applyInPandasWithState(_step(gap_minutes * 60_000_000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("last_us").alias("last_event"), "events", F.round("value", 4).alias("value"))


def run_to_end(sessions: DataFrame, path: str, checkpoint: str) -> int:
    """Process all that the stream's source has into Parquet files under path (exactly once, as the checkpoint says what is
    done); the number of rows that came too late."""
    query = sessions.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
