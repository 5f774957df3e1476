"""The life of operations on a stream of their events: keyed state with event-time timers.

An operation is begun by its first event and is running or paused until an event finishes or fails it, or until none has come for ``gap``: then a
timer abandons it when the watermark passes. State is one small row a key; it is kept with the query's checkpoint, so a query
started again goes on with every operation that was open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Instants are microseconds since the epoch, whatever the time zone of the session.
_STATE = "began long, last long, events long, paused long, paused_at long"


def operation_lives(events: DataFrame, finishing: list[str], failing: list[str], pausing: list[str], gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(key, began, ended, events, paused_ms, status), one row an operation that has ended; status is finished, failed or abandoned.

    ``events`` is a stream of (key, at, event). An event out of ``pausing`` pauses its operation, any later one resumes it. The end of an
    abandoned operation is its last event. After the end of an operation its key may begin another one. Events of a key that come in one batch
    are taken in order of time; nulls in ``at`` never reach the state, as the watermark drops them.
    """
    limit = int(pd.Timedelta(gap) / pd.Timedelta("1us"))
    kind = events.schema["key"].dataType.simpleString()

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now = list(state.get) if state.exists else None

        def close(at: int, status: str) -> None:
            began, _, n, paused, paused_at = now
            out.append((key[0], began, at, n, (paused + (0 if paused_at is None else at - paused_at)) // 1000, status))

        if state.hasTimedOut:
            close(now[1], "abandoned")
            now = None
        else:
            rows = pd.concat(list(frames)).sort_values(["us", "event"], kind="stable")
            for at, event in zip(rows["us"].tolist(), rows["event"].tolist()):
                if now is not None and at - now[1] > limit:
                    close(now[1], "abandoned")
                    now = None
                if now is None:
                    now = [at, at, 0, 0, None]
                if now[4] is not None and event not in pausing:
                    now[3], now[4] = now[3] + at - now[4], None
                elif event in pausing and now[4] is None:
                    now[4] = at
                now[1], now[2] = max(now[1], at), now[2] + 1
                if event in finishing or event in failing:
                    close(at, "finished" if event in finishing else "failed")
                    now = None
        if now is not None:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max((now[1] + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "began", "ended", "events", "paused_ms", "status"])

    schema = f"key {kind}, began long, ended long, events long, paused_ms long, status string"
    timed = events.withWatermark("at", lateness).select("key", "at", F.unix_micros("at").alias("us"), "event")
    lives = timed.groupBy("key").applyInPandasWithState(follow, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return lives.withColumns({c: F.timestamp_micros(c) for c in ("began", "ended")})
