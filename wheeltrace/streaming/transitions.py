"""Live transitions and windows on a stream of state samples: an extension that the batch operators do not need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(stream: DataFrame, *, late: str = "10 seconds", size: str = "5 seconds", slide: str = "500 milliseconds") -> DataFrame:
    """Samples and assisted share of each route in sliding windows; rows later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "route_id").agg(F.count("*").alias("n"), F.avg("state").alias("share"))


def live_transitions(stream: DataFrame, *, min_samples: int, late_s: float = 0.0, ts: str | None = None, idle: str = "1 hour") -> DataFrame:
    """(route_id, time_s, state): a change is reported once the new state has lasted min_samples samples.
    stream: route_id, time_s, state.

    Samples that come within late_s of their route's latest time take their place in order, also over batches; until then
    they are held in the route's state. Those that come later still are dropped, as behind a watermark. With `ts`, a column
    of event times over all routes, a route that the watermark has left behind by `idle` gives what it holds, and its state
    is removed; without one, states stay."""
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steady, run, n, since, done, times, states = state.get if state.exists else (-1, -1, 0, 0.0, float("-inf"), [], [])
        rows, latest, over = list(zip(times, states, strict=True)), 0, state.hasTimedOut
        for pdf in [] if over else batches:
            rows += [(float(t), int(s)) for t, s in zip(pdf.time_s, pdf.state, strict=True) if t > done]
            if ts:
                latest = max(latest, int(pdf._ts.max().timestamp() * 1000))
        rows.sort()
        ready = rows[-1][0] - late_s if rows and not over else float("inf")
        out: list[tuple] = []
        for t, s in rows:
            if t > ready:
                break
            run, n, since = (run, n + 1, since) if s == run else (s, 1, t)
            if n == min_samples and run != steady:
                if steady >= 0:
                    out.append((key[0], since, run))
                steady = run
            done = t
        if over:
            state.remove()
        else:
            rest = [r for r in rows if r[0] > ready]
            state.update((steady, run, n, since, done, [t for t, _ in rest], [s for _, s in rest]))
            if ts:
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame(out, columns=["route_id", "time_s", "state"])

    rows, timeout = stream.select("route_id", "time_s", "state"), GroupStateTimeout.NoTimeout
    if ts:
        rows, timeout = stream.select("route_id", "time_s", "state", F.col(ts).alias("_ts")).withWatermark("_ts", f"{late_s} seconds"), GroupStateTimeout.EventTimeTimeout
    kept = "steady int, run int, n int, since double, done double, held_s array<double>, held_state array<int>"
    return rows.groupBy("route_id").applyInPandasWithState(step, "route_id long, time_s double, state int", kept, "append", timeout)
