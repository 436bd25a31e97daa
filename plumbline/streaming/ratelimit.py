"""Sliding-window rate limits per key and tier, with state across batches."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Requests a minute of each tier.
TIERS = {"free": 100, "pro": 1_000, "api_starter": 10_000, "api_growth": 100_000, "enterprise": 1_000_000}


def cap(tier: Column, tiers: dict[str, int]) -> Column:
    """The tier's limit; unknown tiers have the smallest."""
    pick = F.lit(min(tiers.values()))
    for name, n in tiers.items():
        pick = F.when(tier == name, F.lit(n)).otherwise(pick)
    return pick.cast("long")


class Window:
    """The times (microseconds) that still count for one key: at most as many as the limit, oldest first."""

    def __init__(self, times, micros: int, count_refused: bool):
        self.times, self.micros, self.count_refused = deque(times), micros, count_refused

    def ask(self, at: int, most: int) -> tuple[bool, int, int | None]:
        """(allowed, requests left, seconds to wait if refused) of a request at a time; both ends of the window count."""
        while self.times and self.times[0] < at - self.micros:
            self.times.popleft()
        while len(self.times) > most:  # the tier became smaller: only the last `most` can matter
            self.times.popleft()
        allowed = len(self.times) < most
        wait = None if allowed else ((self.times[0] + self.micros - at) // 1_000_000 + 1 if most else self.micros // 1_000_000)
        if allowed or self.count_refused:
            self.times.append(at)
            if len(self.times) > most:
                self.times.popleft()
        return allowed, max(0, most - len(self.times)) if allowed else 0, wait


def decisions(requests: DataFrame, key: str, request: str, ts: str, tier: str, tiers: dict[str, int] = TIERS, seconds: int = 60, count_refused: bool = False, delay: str = "10 minutes") -> DataFrame:
    """(key, request, ts, most, allowed, remaining, retry_after) of each request of a stream.

    Within a batch requests are taken in order of time, then id; one that comes later than the batch of its time is judged against
    what is remembered then. A refused request counts towards the window only if `count_refused`. A key's state (its last times) goes
    once event time has passed its window by `delay`. Null keys, ids and times take no part.
    """
    kind, own = requests.schema[key].dataType.simpleString(), requests.schema[request].dataType.simpleString()
    micros = seconds * 1_000_000

    def decide(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(state.get[0] if state.exists else (), micros, count_refused)
        asked = pd.concat(list(frames)).sort_values(["at", request])
        said = [window.ask(int(at), int(most)) for at, most in zip(asked["at"], asked["most"], strict=True)]
        state.update((list(window.times),))
        gone = int(asked["at"].max()) // 1000 + seconds * 1000 + 1
        state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], request: asked[request], "at": asked["at"], "most": asked["most"], "allowed": [s[0] for s in said], "remaining": [s[1] for s in said], "retry_after": pd.array([s[2] for s in said], dtype="Int64")})

    rows = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).where(F.col(key).isNotNull() & F.col(request).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(key, request, ts, F.unix_micros(ts).alias("at"), cap(F.col(tier), tiers).alias("most"))
    out = rows.groupBy(key).applyInPandasWithState(decide, f"{key} {kind}, {request} {own}, at long, most long, allowed boolean, remaining long, retry_after long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(ts, F.timestamp_micros("at")).drop("at")
