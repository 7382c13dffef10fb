"""Recovery: snapshots, recovery points, tails, and repair of a faulty log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tideline.functions import bucket_start, from_micros, micros
from tideline.operators.replay import STATE, event_state, merge_states
from tideline.operators.validate import paired_events
from tideline.sources import publish, published, read_dated, read_published, withdraw

CUT_STATE = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("amount", T.DecimalType(38, 2)), T.StructField("last_kind", T.StringType()),
    T.StructField("last_ts_us", T.LongType()), T.StructField("last_event_id", T.LongType())])
_CUT_NAME = "%Y%m%dT%H%M%S.%f"


def snapshots(log: DataFrame, every: str = "1 day") -> DataFrame:
    """State of every user at the end of each period in which it had an event (``ts < cut_ts``).

    Events are reduced to one partial state per (user, period) before anything is ordered, so
    the running sums see at most one row per user and period.
    """
    width = micros(every)
    cells = event_state(log.withColumn("_cut", bucket_start(F.col("ts_us"), width) + width),
                        "user_id", "_cut")
    upto = Window.partitionBy("user_id").orderBy("_cut").rowsBetween(
        Window.unboundedPreceding, 0)
    return cells.select(
        "user_id", from_micros(F.col("_cut")).alias("cut_ts"), F.sum("n").over(upto).alias("n"),
        F.sum("amount").over(upto).cast("decimal(38,2)").alias("amount"),
        "last_kind", "last_ts_us", "last_event_id")


def snapshot_at(snaps: DataFrame, cut: str) -> DataFrame:
    """Newest snapshot of every user at or before one cut time."""
    newest = F.max(F.struct("cut_ts", *STATE))
    return (snaps.where(F.col("cut_ts") <= F.expr(f"timestamp_ntz'{cut}'"))
            .groupBy("user_id").agg(newest.alias("_s")).select("user_id", "_s.*"))


def recover_state(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Snapshot plus replay of the events after it. Both are partial states, merged once."""
    return merge_states(snapshot.select("user_id", *STATE)
                        .unionByName(event_state(tail, "user_id")), "user_id")


def _cut_name(cut: str | datetime) -> str:
    return (cut if isinstance(cut, datetime) else datetime.fromisoformat(cut)).strftime(_CUT_NAME)


def cuts(spark: SparkSession, path: str) -> list[datetime]:
    """The times of the stored cuts, oldest first. A cut holds the state of every user before its
    time and is published when it is whole, so a crash while one is written shows the others."""
    return [datetime.strptime(name, _CUT_NAME) for name in published(spark, path)]


def read_cut(spark: SparkSession, path: str, cut: str | datetime) -> DataFrame:
    return read_published(spark, path, CUT_STATE, [_cut_name(cut)])


def state_at(spark: SparkSession, path: str, log: str, schema: T.StructType,
             at: str | None = None) -> DataFrame:
    """State of every user before ``at`` (or after the whole log), from the newest stored cut up to
    then and the days of the dated log (``write_dated``) after it; older days are not read."""
    known = [c for c in cuts(spark, path) if at is None or c <= datetime.fromisoformat(at)]
    start = str(known[-1]) if known else None
    tail = event_state(read_dated(spark, log, schema, start=start, end=at), "user_id")
    if not known:
        return tail
    return merge_states(read_cut(spark, path, known[-1]).unionByName(tail), "user_id")


def extend_cuts(spark: SparkSession, path: str, log: str, schema: T.StructType, cut: str) -> None:
    """Store the cut at ``cut``: the newest one before it, merged with the days in between.

    A cut that is there already is kept. Events that come for days before a stored cut need
    :func:`withdraw_cuts` first.
    """
    if datetime.fromisoformat(cut) not in cuts(spark, path):
        publish(state_at(spark, path, log, schema, cut), path, _cut_name(cut))


def withdraw_cuts(spark: SparkSession, path: str, since: str) -> None:
    """Take away the cuts after ``since``, the time of the first event that they lack. The newest
    goes first, so that no cut is ever extended from one that is about to go."""
    for cut in reversed(cuts(spark, path)):
        if cut > datetime.fromisoformat(since):
            withdraw(spark, path, _cut_name(cut))


def recovery_point(snaps: DataFrame, targets: DataFrame) -> DataFrame:
    """Newest snapshot at or before ``target_ts`` of each user; nulls where there is none."""
    newest = F.max(F.when(F.col("cut_ts") <= F.col("target_ts"), F.struct("cut_ts", *STATE)))
    return (targets.select("user_id", "target_ts").join(snaps, "user_id", "left")
            .groupBy("user_id", "target_ts").agg(newest.alias("_s"))
            .select("user_id", "target_ts", "_s.*"))


def tail_events(log: DataFrame, points: DataFrame) -> DataFrame:
    """Events to replay from each user's recovery point up to its target time.

    A user without a snapshot is replayed from the beginning. The join keeps no broadcast
    hint: points grow with the users. Hot users are split by the adaptive skew join.
    """
    p = points.select("user_id", "cut_ts", "target_ts")
    after = F.col("cut_ts").isNull() | (F.col("ts") >= F.col("cut_ts"))
    return (log.join(p, "user_id").where(after & (F.col("ts") < F.col("target_ts")))
            .drop("cut_ts", "target_ts"))


def repair_log(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """The observed log made good: missing events added, altered ones restored, extra ones and
    repeats dropped. ``action`` says what was done to each remaining event; expected events
    without an id stay and are called ``unidentified``."""
    pairs = paired_events(expected, observed).where("status <> 'extra' and e is not null")
    action = (F.when(F.col("status") == "missing", "added")
              .when(F.col("status") == "altered", "restored")
              .when(F.col("status") == "unidentified", "unidentified").otherwise("kept"))
    return pairs.select("event_id", "e.*", action.alias("action"))
