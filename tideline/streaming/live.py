"""Operators on a live log (a stream of raw events, ``ts`` as TIMESTAMP).

Results appear in append mode: a window is emitted once it ends at or before
``max(ts) - delay``, and never changes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

SALTS = 64


def _is_error():
    return F.col("event_type") == "error"


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def stream_error_rate(stream: DataFrame, width: str = "1 hour", slide: str | None = None,
                      delay: str = "1 hour") -> DataFrame:
    """Events and errors per closed window, tumbling or sliding."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = (stream.withWatermark("ts", delay).groupBy(window.alias("w"))
           .agg(F.count("*").alias("n_events"), F.count_if(_is_error()).alias("n_errors"))
           .select(F.col("w.start").alias("window_start"), "n_events", "n_errors"))
    return _ntz(out, "window_start")


def stream_incidents(stream: DataFrame, gap: str = "24 hours",
                     delay: str = "1 hour") -> DataFrame:
    """Closed incidents: sessions of errors of one user. The watermark follows the errors."""
    out = (stream.where(_is_error()).withWatermark("ts", delay)
           .groupBy("user_id", F.session_window("ts", gap).alias("w"))
           .agg(F.count("*").alias("n_errors"))
           .select("user_id", F.col("w.start").alias("start_ts"),
                   (F.col("w.end") - F.expr(f"interval {gap}")).alias("end_ts"), "n_errors"))
    return _ntz(out, "start_ts", "end_ts")


def stream_dedupe(stream: DataFrame, delay: str = "1 hour", salts: int = SALTS) -> DataFrame:
    """Drop repeats of an event that come within ``delay`` of each other.

    Copies of one event meet in one task. So that a storm of copies does not, repeats are
    dropped per (event, salt) first and then per event, which leaves at most ``salts`` copies
    for the second step. Which salt a copy gets does not matter for the result. Events without
    an id are no repeats and pass.
    """
    marked = stream.withWatermark("ts", delay)
    salted = marked.where("event_id is not null").withColumn(
        "_salt", F.floor(F.rand() * salts).cast("int"))
    first = (salted.dropDuplicatesWithinWatermark(["event_id", "_salt"])
             .dropDuplicatesWithinWatermark(["event_id"]).drop("_salt"))
    return first.unionByName(marked.where("event_id is null"))


def stream_period_state(stream: DataFrame, every: str = "1 hour",
                        delay: str = "1 hour") -> DataFrame:
    """State of every user after each closed period in which it had an event, in order.

    Events are reduced to one partial state per (user, period) by a windowed aggregate, which
    works map-side. Periods close in time order, so the custom state below it only has to
    apply the periods of one batch in order: it needs no buffer across batches and no timers,
    and a hot user costs it one row per period.
    """
    last = F.max(F.struct(F.col("ts"), F.col("event_id"), F.col("event_type").alias("kind")))
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long")
    cells = (stream.withWatermark("ts", delay)
             .groupBy(F.window("ts", every).alias("w"), "user_id")
             .agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), last.alias("_last"))
             .select("user_id", F.unix_micros("w.end").alias("cut_us"), "n", "cents",
                     F.col("_last.kind").alias("last_kind"),
                     F.col("_last.event_id").alias("last_event_id")))
    shape = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("cut_us", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("cents", T.LongType()),
        T.StructField("last_kind", T.StringType()),
        T.StructField("last_event_id", T.LongType())])
    out = cells.groupBy("user_id").transformWithStateInPandas(
        _running_totals(), shape, "append", "none")
    return out.select(
        "user_id", F.timestamp_micros("cut_us").cast("timestamp_ntz").alias("cut_ts"), "n",
        (F.col("cents").cast("decimal(36,2)") / 100).cast("decimal(38,2)").alias("amount"),
        "last_kind", "last_event_id")


def _running_totals():
    """The processor, made here so that it travels to the workers by value."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class RunningTotals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", "n bigint, cents bigint")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame],
                            timerValues: Any) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows)).sort_values("cut_us", ignore_index=True)
            n, cents = self.total.get() or (0, 0)
            pdf["n"] = pdf["n"].cumsum() + n
            pdf["cents"] = pdf["cents"].cumsum() + cents
            self.total.update((int(pdf["n"].iloc[-1]), int(pdf["cents"].iloc[-1])))
            yield pdf[["user_id", "cut_us", "n", "cents", "last_kind", "last_event_id"]]

        def close(self) -> None:
            pass

    return RunningTotals()


def stream_enrich(stream: DataFrame, customer: DataFrame, salts: int = 16) -> DataFrame:
    """Attach the segment of the entity; unknown entities are kept.

    Streams are not re-planned at run time, so the events of a hot entity are spread by salt
    and the static side is repeated per salt. Spark does not count the repeats when it decides
    whether to broadcast, so the join is a merge of sorted, shuffled sides at every size.
    """
    who = customer.select(F.col("c_custkey").alias("user_id"),
                          F.col("c_mktsegment").alias("segment"),
                          F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))
                          .alias("_salt"))
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    return _ntz(salted.join(who.hint("merge"), ["user_id", "_salt"], "left").drop("_salt"), "ts")
