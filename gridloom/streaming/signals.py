"""Signals on a stream: the long-short machine with its state kept by code, in the order of dates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIGNALS = "code string, date date, signal int"
_EVENTS = ("lo", "so", "lc", "sc")


def next_state(state: int, lo: bool, so: bool, lc: bool, sc: bool) -> int:
    """Where a row's events take a state: lo opens a long (before so a short), lc closes it (to a short on so), sc a short (to a long on lo)."""
    if state == 0:
        return 1 if lo else -1 if so else 0
    if state == 1:
        return (-1 if so else 0) if lc else 1
    return (1 if lo else 0) if sc else -1


class SignalMachine(StatefulProcessor):
    """Holds a code's rows until the watermark has passed their date, then takes them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state int")
        self.waiting = handle.getListState("waiting", "day long, lo boolean, so boolean, lc boolean, sc boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if batch.empty:  # a code that only a timer calls for
                continue
            days = [int(pd.Timestamp(at).timestamp() * 1000) for at in batch["at"]]
            for day, *events in zip(days, *[batch[c] for c in _EVENTS], strict=True):
                self.waiting.appendValue((day, *map(bool, events)))
                self.handle.registerTimer(day)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= upto]
        later = [r for r in rows if r[0] > upto]
        self.waiting.put(later) if later else self.waiting.clear()
        state, out = self.state.get()[0] if self.state.exists() else 0, []
        for day, *events in due:
            state = next_state(state, *events)
            out.append((key[0], pd.Timestamp(day, unit="ms").date(), state))
        if out:
            self.state.update((state,))
            yield pd.DataFrame(out, columns=["code", "date", "signal"])

    def close(self) -> None:
        pass


def signal_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """code, date, signal of a stream of events (code, date, lo, so, and lc and sc if closing has events of its own).

    A row waits until the stream has seen a date later by ``delay``; so rows may come in any order within it and give what
    ``timing.long_short_signal`` gives of the whole.  A row later than that is dropped.  A code's waiting rows are those of the delay.  Null
    events are false; rows without a code or date are dropped.
    """
    own = {"lc": F.col("lc") if "lc" in events.columns else F.col("so"), "sc": F.col("sc") if "sc" in events.columns else F.col("lo")}
    x = events.filter("code is not null and date is not null").select("code", F.col("date").cast("timestamp").alias("at"), *[F.coalesce(own.get(c, F.col(c)), F.lit(False)).alias(c) for c in _EVENTS])
    return x.withWatermark("at", delay).groupBy("code").transformWithStateInPandas(statefulProcessor=SignalMachine(), outputStructType=SIGNALS, outputMode="Append", timeMode="EventTime")
