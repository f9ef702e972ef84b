"""Adjudication as a stream: requests are applied in event order, illegal ones refused, service-level deadlines fire as timers.

Requests wait in keyed state until the watermark passes them, so those that arrive late (within the
watermark's delay) still take their turn; later ones are dropped with the watermark. State is one small row and the waiting requests of a
record, timers are one for the next request and one for the deadline. It lives in RocksDB and in the
query's checkpoint, from which a restarted query goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..enums import OPEN_STATUSES, ROLES, SLA_HOURS, TERMINAL_STATUSES, TRANSITIONS

_WAITING = "id long, at long, target string, actor string, role string, priority string"
_RECORD = "status string, assigned_to string, decided_by string, due long, breached boolean"
OUT = "parcel_id long, id long, at timestamp, kind string, was string, target string, reason string, review_status string, assigned_to string, decided_by string"


def refusal(was: str, target: str, role: str | None) -> str | None:
    """Why a request is refused; null if it is not."""
    if was == target:
        return "already there"
    if target not in TRANSITIONS[was]:
        return "not allowed"
    if was in TERMINAL_STATUSES and (role not in ROLES or ROLES.index(role) < ROLES.index("reviewer")):
        return "needs a reviewer"
    return None


class Review(StatefulProcessor):
    """One record: its first request opens it as pending, with a deadline by its priority."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record, self.waiting = handle.getValueState("record", _RECORD), handle.getListState("waiting", _WAITING)
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            at = part["at"].dt.tz_localize(None) if part["at"].dt.tz is not None else part["at"]
            ms = at.astype("datetime64[ms]").astype("int64")
            new += list(zip(part["id"].astype(int).tolist(), ms.tolist(), *(part[c].tolist() for c in ("target", "actor", "role", "priority")), strict=True))
        if new:
            self.waiting.appendList(new)
            self._wake(min(x[1] for x in new))
        yield pd.DataFrame()

    def _wake(self, at: int) -> None:
        known = self.next.get()[0] if self.next.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark, in order; other timers of the record that expire with this one find nothing left."""
        until, parcel, out = timerValues.getCurrentWatermarkInMs(), int(key[0]), []
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[1], x[0])) if self.waiting.exists() else []
        record = tuple(self.record.get()) if self.record.exists() else None

        def deadline(to: int) -> None:
            nonlocal record
            if record is not None and not record[4] and record[3] <= to:
                record = (*record[:4], True)
                if record[0] in OPEN_STATUSES:
                    out.append((parcel, None, record[3], "breach", record[0], None, None, record[0], record[1], record[2]))

        for number, at, target, actor, role, priority in (x for x in waiting if x[1] <= until):
            if record is None:
                due = at + SLA_HOURS[priority] * 3_600_000
                record = ("pending", None, None, due, False)
                self.handle.registerTimer(due)
            deadline(at - 1)
            was, had, by, due, breached = record
            why = refusal(was, target, role)
            if why is None:
                had = (had or actor) if target == "in_review" else had
                record = (target, had, actor if target in TERMINAL_STATUSES else None, due, breached)
            out.append((parcel, number, at, "request", was, target, why, record[0], record[1], record[2]))
        deadline(until)
        if record is not None:
            self.record.update(record)
        left = [x for x in waiting if x[1] > until]
        if waiting:
            self.waiting.put(left) if left else self.waiting.clear()
            known = self.next.get()[0] if self.next.exists() else None
            if known is not None and known <= until:
                self.next.clear()
                if left:
                    self._wake(min(x[1] for x in left))
        frame = pd.DataFrame(out, columns=[x.split(" ")[0] for x in OUT.split(", ")])
        frame["id"] = frame["id"].astype("Int64")
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        yield frame


def reviewed(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Outcomes (OUT) of a stream of requests ``parcel_id, id, at, target, actor, role, priority``: kind request with its reason if refused, or breach."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.select(F.col("parcel_id").cast("long"), "id", F.col("at").cast("timestamp").alias("at"), "target", "actor", "role", "priority").withWatermark("at", late)
    return rows.groupBy("parcel_id").transformWithStateInPandas(Review(), OUT, "Append", "EventTime")
