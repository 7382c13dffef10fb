"""Operators that take the events of a live log in their order, whatever order they arrive in.

Events wait in keyed list state until the watermark has passed them; from then on nothing can
come before them, as Spark drops what is later. Every key has at most one event-time timer, for
the first thing that it waits for: its first event, or the end of something open. When the timer
fires, all events that the watermark has passed are taken in one go, and the timer is set anew if
anything is left. So a key that waits for nothing has no timer, and no waiting rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.functions import micros

NO_ID = -(1 << 63)


def _in_order():
    """The base class, made here so that it travels to the workers by value."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class InOrder(StatefulProcessor):
        """Subclasses say what waits (``WAITING``, of which ``ts_us`` is the first field), and what
        becomes of the rows that are due: ``take`` returns a frame or None and the next time in
        microseconds that the key waits for besides, or None. What waits in another form also has
        a ``store`` and a ``split`` of its own."""

        WAITING = ""

        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", self.WAITING)
            self.alarm = handle.getValueState("alarm", "ms bigint")
            self.open()

        def open(self) -> None:
            pass

        def _wake(self, us: int | None) -> None:
            """Have at most one timer, at the first full millisecond not before ``us``."""
            old, ms = self.alarm.get(), None if us is None else -(-us // 1000)
            if old is not None and old[0] != ms:
                self.handle.deleteTimer(old[0])
                self.alarm.clear()
            if ms is not None and (old is None or old[0] != ms):
                self.handle.registerTimer(ms)
                self.alarm.update((ms,))

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
            first = None
            for pdf in rows:
                if len(pdf):
                    self.store(pdf)
                    low = int(pdf["ts_us"].min())
                    first = low if first is None else min(first, low)
            old = self.alarm.get()
            if first is not None and (old is None or -(-first // 1000) < old[0]):
                self._wake(first)
            return iter(())

        def store(self, pdf: pd.DataFrame) -> None:
            names = [f.split()[0] for f in self.WAITING.split(", ")]
            self.waiting.appendList([tuple(r) for r in pdf[names].astype(object).itertuples(index=False)])

        def split(self, mark: int) -> tuple[Any, int | None]:
            """Take the rows that are due from those that wait; also the first time of the others."""
            due, rest = [], []
            for row in self.waiting.get():
                (due if row[0] <= mark else rest).append(tuple(row))
            if due and rest:
                self.waiting.put(rest)
            elif due:
                self.waiting.clear()
            return due, min(r[0] for r in rest) if rest else None

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
            self.alarm.clear()  # a timer that has fired is gone
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            due, rest = self.split(mark)
            made, more = self.take(key, due, mark)
            times = [t for t in (rest, more) if t is not None]
            self._wake(min(times) if times else None)
            if made is not None and len(made):
                yield made

        def take(self, key: Any, due: Any, mark: int) -> tuple[pd.DataFrame | None, int | None]:
            raise NotImplementedError

        def close(self) -> None:
            pass

    return InOrder


STATES = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("cents", T.LongType()), T.StructField("last_kind", T.StringType())])


def _running_states():
    class RunningStates(_in_order()):
        WAITING = "ts_us bigint, event_id bigint, cents bigint, kind string"

        def open(self) -> None:
            self.total = self.handle.getValueState("total", "n bigint, cents bigint")

        def take(self, key, due, mark):
            if not due:
                return None, None
            due.sort(key=lambda r: r[:2])
            n, cents = self.total.get() or (0, 0)
            ts, ids, spent, kinds = zip(*due)
            total = np.cumsum(np.array(spent, np.int64)) + cents
            self.total.update((n + len(due), int(total[-1])))
            return pd.DataFrame({
                "user_id": pd.array([key[0]] * len(due), "Int64"),
                "event_id": pd.array([None if i == NO_ID else i for i in ids], "Int64"),
                "ts_us": ts, "n": np.arange(n + 1, n + len(due) + 1), "cents": total,
                "last_kind": pd.Series(kinds, dtype=object)}), None

    return RunningStates()


def stream_replay_state(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State of its user after every event, in the order of the log (time, then id).

    An event appears once the watermark, the latest time seen less ``delay``, has reached its
    time; events that arrive after that are dropped. Events without a time have no place in the
    order and are left out; a user of null is a user like any other; missing amounts add nothing.
    Events of one user wait and are taken in one task, as their states depend on each other: the
    memory that takes is that of the user's events of ``delay`` and of one batch. For states by
    period, which a busy user costs one row each, see ``stream_period_state``.
    """
    cents = F.coalesce((F.col("value").cast("decimal(18,2)") * 100).cast("long"), F.lit(0))
    rows = stream.where("ts is not null").withWatermark("ts", delay).select(
        "ts", "user_id", F.unix_micros("ts").alias("ts_us"),
        F.coalesce("event_id", F.lit(NO_ID).cast("long")).alias("event_id"),
        cents.alias("cents"), F.col("event_type").alias("kind"))
    out = rows.groupBy("user_id").transformWithStateInPandas(_running_states(), STATES, "append", "EventTime")
    return out.select(
        "event_id", "user_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "n",
        (F.col("cents").cast("decimal(36,2)") / 100).cast("decimal(38,2)").alias("amount"), "last_kind")


RECOVERIES = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("error_us", T.LongType()),
    T.StructField("recovered_us", T.LongType())])


#: Users by the remainder of their number; a prime, so that numbers in steps are spread as well.
GROUPS = 251


def _recoveries(within: int):
    class Recoveries(_in_order()):
        """Many users at once: a list element is a block of rows, four numbers each (time, user,
        1 for none, 1 for an error), so that the state is asked per batch and key, not per event."""

        WAITING = "block binary"

        def open(self) -> None:
            self.errors = self.handle.getListState("errors", "block binary")

        @staticmethod
        def rows_of(blocks) -> np.ndarray:
            return np.concatenate([np.empty((0, 4), np.int64), *[
                np.frombuffer(bytes(b[0]), np.int64).reshape(-1, 4) for b in blocks]])

        @staticmethod
        def put(state, rows: np.ndarray) -> None:
            if len(rows):
                state.put([(rows.tobytes(),)])
            else:
                state.clear()

        def store(self, pdf: pd.DataFrame) -> None:
            self.waiting.appendValue((pdf[["ts_us", "user", "nobody", "error"]].to_numpy(np.int64).tobytes(),))

        def split(self, mark: int) -> tuple[np.ndarray, int | None]:
            rows = self.rows_of(self.waiting.get())
            due = rows[:, 0] <= mark
            rest = rows[~due]
            if due.any():
                self.put(self.waiting, rest)
            return rows[due], int(rest[:, 0].min()) if len(rest) else None

        def take(self, key, due, mark):
            rows = np.concatenate([self.rows_of(self.errors.get()), due])
            # other events before the errors of their time, as a recovery is later than its error
            rows = rows[np.lexsort((rows[:, 3], rows[:, 0], rows[:, 1], rows[:, 2]))]
            n, error = len(rows), rows[:, 3] == 1
            after = np.minimum.accumulate(np.where(error, n, np.arange(n))[::-1])[::-1]
            first = error & np.append(True, (rows[1:] != rows[:-1]).any(1))[:n]
            errors, after = rows[first], after[first]
            at = errors[:, 0]
            next_ = rows[np.minimum(after, n - 1)]
            found = (after < n) & (next_[:, 1:3] == errors[:, 1:3]).all(1)
            over = found | (at + within <= mark)
            left = errors[~over]
            self.put(self.errors, left)
            in_time = found & (next_[:, 0] - at <= within)
            made = pd.DataFrame({
                "user_id": pd.array(errors[over, 1], "Int64"), "error_us": at[over],
                "recovered_us": pd.array(next_[:, 0], "Int64")[over]})
            made.loc[errors[over, 2] == 1, "user_id"] = pd.NA
            made.loc[~in_time[over], "recovered_us"] = pd.NA
            return made, int(left[:, 0].min()) + within if len(left) else None

    return Recoveries()


def stream_error_recovery(stream: DataFrame, within: str = "1 hour", delay: str = "1 hour",
                          stretch: str = "1 day") -> DataFrame:
    """The times at which a user had errors, each once, with the time of the next other event of
    the user (``recovered_ts``) if that comes at most ``within`` later, else with null.

    A recovery appears once the watermark has reached it, and its lack once the watermark is
    ``within`` past the error. State is kept per group of users and ``stretch`` of time: the events
    of a stretch, and other events up to ``within`` after it, so the stretches of a busy user are
    different keys. The key ``user_id`` is the remainder of the user's number by ``GROUPS``, as a
    call and its requests to the state cost the same for many users as for one. The state holds
    single times: waiting ones, and errors without a recovery yet, which have a timer. A stretch
    that is over leaves nothing behind. ``stretch`` and ``GROUPS`` change no result.
    """
    reach, width = micros(within), micros(stretch)
    if reach > width:
        raise ValueError("a stretch is no shorter than the time within which an error recovers")
    user = F.coalesce("user_id", F.lit(0)).cast("long")
    rows = stream.where("ts is not null").withWatermark("ts", delay).select(
        "ts", (user % GROUPS).alias("user_id"), user.alias("user"), F.col("user_id").isNull().alias("nobody"),
        F.unix_micros("ts").alias("ts_us"),
        F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("error"))
    cell = F.expr(f"(ts_us - pmod(ts_us, {width})) div {width}")
    near = ~F.col("error") & (F.pmod("ts_us", F.lit(width)) <= reach)
    dealt = rows.withColumn("cell", F.explode(F.when(near, F.array(cell, cell - 1)).otherwise(F.array(cell))))
    out = dealt.groupBy("user_id", "cell").transformWithStateInPandas(
        _recoveries(reach), RECOVERIES, "append", "EventTime")
    return out.select("user_id", *[
        F.timestamp_micros(f"{n}_us").cast("timestamp_ntz").alias(f"{n}_ts") for n in ("error", "recovered")])
