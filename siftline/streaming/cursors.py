"""Cursors as keyed state of a stream: tokens are put and taken, each once, and expire with the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ANSWERS = "token string, at timestamp, found boolean, cursor string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cursors(StatefulProcessor):
    """A token's requests wait until the watermark has passed them and are then answered in the order of their times."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("token", "waiting string, kept string, until long")

    def _read(self) -> tuple[list, str | None, int]:
        told = self.state.get() if self.state.exists() else None
        return (json.loads(told[0]), told[1], told[2]) if told else ([], None, 0)

    def _timer(self, waiting: list, kept: str | None, until: int) -> None:
        """One timer a token, for what comes next; what each request costs stays the same however many a token has."""
        times = [w[0] for w in waiting] + ([until] if kept is not None else [])
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        waiting, kept, until = self._read()
        for part in rows:
            for at, put, cursor in zip(part["at_us"], part["put"], part["cursor"], strict=True):
                waiting.append([int(at), bool(put), None if pd.isna(cursor) else str(cursor)])
        self.state.update((json.dumps(waiting), kept, until))
        self._timer(waiting, kept, until)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        # nothing earlier than the watermark comes any more, so all that it has passed is answered at once
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting, kept, until = self._read()
        answers = []
        for at, put, cursor in sorted((w for w in waiting if w[0] <= now), key=lambda w: w[:2]):
            alive = kept is not None and at < until
            if put:
                kept, until = cursor, at + self.ttl_us
            else:
                answers.append((key[0], pd.Timestamp(at, unit="us"), alive, kept if alive else None))
                kept = None
        waiting = [w for w in waiting if w[0] > now]
        if kept is not None and until <= now:
            kept = None
        if waiting or kept is not None:
            self.state.update((json.dumps(waiting), kept, until))
            self._timer(waiting, kept, until)
        elif self.state.exists():
            self.state.clear()  # nothing of an expired or spent token stays
        if answers:
            yield pd.DataFrame(answers, columns=["token", "at", "found", "cursor"])


def cursor_answers(requests: DataFrame, ttl_seconds: float = 120.0, delay: str = "10 minutes") -> DataFrame:
    """ANSWERS to a stream of requests (token, at, put, cursor): one row for each that takes a token.

    A put replaces what the token held and lives for ``ttl_seconds`` of event time; a take
    finds it once. Requests may come ``delay`` late and in any order, later ones are lost.
    Several of one instant: takes go first. Needs the state store that keeps timers.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = requests.select("token", "at", F.unix_micros("at").alias("at_us"), "put", "cursor").filter("token is not null and at is not null").withWatermark("at", delay)
    return rows.groupBy("token").transformWithStateInPandas(_Cursors(int(ttl_seconds * 1e6)), ANSWERS, "Append", "EventTime")
