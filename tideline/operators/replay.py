"""Replay: the state of every entity as a fold of its events in order.

State of an entity: event count ``n``, amount total ``amount``, last kind, last time and last
event id. States of disjoint stretches of a log merge (sums, and the later last event), which
is what makes map-side aggregation, snapshots and recovery possible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.operators.normalise import ORDER, total_order
from tideline.operators.ordered import Layout, Scan, scan

STATE = ["n", "amount", "last_kind", "last_ts_us", "last_event_id"]
FAN = 1024


def event_state(log: DataFrame, *keys: str) -> DataFrame:
    """Partial states of the events of each key, aggregated map-side."""
    last = F.max(F.struct(F.col("ts_us"), F.col("event_id"), F.col("kind")))
    return (log.groupBy(*keys)
            .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), last.alias("_last"))
            .select(*keys, "n", F.col("amount").cast("decimal(38,2)").alias("amount"),
                    F.col("_last.kind").alias("last_kind"),
                    F.col("_last.ts_us").alias("last_ts_us"),
                    F.col("_last.event_id").alias("last_event_id")))


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """Merge partial states per key."""
    last = F.max(F.struct("last_ts_us", "last_event_id", "last_kind"))
    return (states.groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), last.alias("_last"))
            .select(*keys, "n", F.col("amount").cast("decimal(38,2)").alias("amount"),
                    "_last.last_kind", "_last.last_ts_us", "_last.last_event_id"))


def replay_running_state(log: DataFrame, layout: Layout) -> DataFrame:
    """State after every event."""
    out = scan(log, ["user_id"], ORDER, {
        "n": Scan("sum", F.lit(1).cast("long")),
        "total": Scan("sum", F.col("amount"))}, layout)
    return out.select("event_id", "user_id", "ts", "n", F.col("total").alias("amount"),
                      F.col("kind").alias("last_kind"))


def replay_as_of(log: DataFrame, t: str) -> DataFrame:
    """State at time ``t``: all events with ``ts < t``. The bound reaches the scan."""
    return event_state(log.where(F.col("ts") < F.expr(f"timestamp_ntz'{t}'")), "user_id")


def replay_final_state(log: DataFrame) -> DataFrame:
    """State after the whole log. No window: partial states are built before the shuffle."""
    return event_state(log, "user_id")


def _rounds(log: DataFrame, level: DataFrame, up: Callable[[DataFrame], DataFrame], fan: int) -> DataFrame:
    """Merge the stretches (``user_id``, ``_seg``, state) of a fold upwards until one is left per
    user. How many rounds are needed is counted from the ``log``, map-side over one column."""
    most = log.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    stretches = -(-most // fan)
    while stretches > 1:
        level = up(level.withColumn("_up", F.expr(f"_seg div {fan}")))
        stretches = -(-stretches // fan)
    return level


def _fold(log: DataFrame, layout: Layout, fields: Sequence[str],
          leaf: Callable[[Column], Column], node: Callable[[Column], Column],
          fan: int) -> DataFrame:
    """Ordered fold in rounds. No group of any round has more than ``fan`` members."""
    def up(level: DataFrame) -> DataFrame:
        return (level.groupBy("user_id", F.col("_up").alias("_seg"))
                .agg(F.array_sort(F.collect_list(F.struct(F.col("_seg").alias("s"), "acc")))
                     .alias("_parts"))
                .select("user_id", "_seg", F.transform("_parts", lambda p: p["acc"])
                        .alias("_parts"))
                .select("user_id", "_seg", F.when(F.size("_parts") == 1, F.col("_parts")[0])
                        .otherwise(node(F.col("_parts"))).alias("acc")))

    leaves = total_order(log, layout).withColumn("_seg", F.expr(f"(seq - 1) div {fan}"))
    leaves = (leaves.groupBy("user_id", "_seg")
              .agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("_rows"))
              .select("user_id", "_seg", leaf(F.col("_rows")).alias("acc")))
    return _rounds(log, leaves, up, fan).select("user_id", "acc")


def fold_events(log: DataFrame, layout: Layout, fields: Sequence[str], init: Column,
                step: Callable[[Column, Column], Column],
                merge: Callable[[Column, Column], Column], fan: int = FAN) -> DataFrame:
    """General ordered fold per user with built-in expressions: column ``acc``.

    ``step(acc, event)`` takes the next event, ``merge(left, right)`` joins the results of two
    neighbouring stretches, as in Spark's own aggregators. Stretches of at most ``fan`` events
    are folded in parallel, so an entity of any size is never collected whole.
    """
    return _fold(log, layout, fields,
                 lambda rows: F.aggregate(rows, init, step),
                 lambda parts: F.aggregate(F.slice(parts, 2, fan), parts[0], merge), fan)


def hash_chain(log: DataFrame, layout: Layout, fields: Sequence[str] = ("event_id", "kind"),
               fan: int = FAN) -> DataFrame:
    """Final link per user of a chain in which each link covers the previous one.

    A plain chain is sequential over an entity. Here events are chained within stretches of
    ``fan``, and the ends of the stretches are chained in turn; a stretch alone is its own end.
    The value depends on the events and on ``fan`` only, not on the layout.
    """
    def text(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("N"))

    def link(acc: Column, row: Column) -> Column:
        return F.sha2(F.concat_ws("|", acc, *[text(row[f]) for f in fields]), 256)

    return _fold(log, layout, fields,
                 lambda rows: F.aggregate(rows, F.lit(""), link),
                 lambda parts: F.aggregate(
                     parts, F.lit(""), lambda acc, p: F.sha2(F.concat_ws("|", acc, p), 256)),
                 fan).withColumnRenamed("acc", "chain")


def fold_events_py(log: DataFrame, layout: Layout,
                   fold: Callable[[pd.DataFrame], dict],
                   merge: Callable[[Iterable[dict]], dict],
                   schema: T.StructType, fan: int = 100_000) -> DataFrame:
    """User-written fold where expressions cannot say it.

    ``fold`` gets at most ``fan`` consecutive events of one user in order and returns a state
    (a dict of ``schema``); ``merge`` joins states of consecutive stretches, in order.
    """
    names = schema.fieldNames()
    full = T.StructType([T.StructField("user_id", T.LongType()),
                         T.StructField("_seg", T.LongType()), *schema.fields])

    def row(key: tuple[Any, ...], state: dict) -> pd.DataFrame:
        return pd.DataFrame([[key[0], key[1], *[state[n] for n in names]]],
                            columns=["user_id", "_seg", *names])

    def leaf(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        return row(key, fold(pdf.sort_values("seq", ignore_index=True)))

    def node(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        return row(key, merge(pdf[names].to_dict("records")))

    leaves = total_order(log, layout).withColumn("_seg", F.expr(f"(seq - 1) div {fan}"))
    leaves = leaves.groupBy("user_id", "_seg").applyInPandas(leaf, full)
    return _rounds(log, leaves, lambda level: level.groupBy("user_id", "_up").applyInPandas(node, full),
                   fan).select("user_id", *names)


def error_streaks(log: DataFrame, layout: Layout, fan: int = FAN) -> DataFrame:
    """Longest run of consecutive errors per user, as an ordered fold.

    A stretch is summed up by its length, the errors at its head and tail, and its best run.
    """
    def state(n, head, tail, best):
        return F.struct(n.cast("long").alias("n"), head.cast("long").alias("head"),
                        tail.cast("long").alias("tail"), best.cast("long").alias("best"))

    def step(acc, e):
        err = e["kind"] == "error"
        tail = F.when(err, acc["tail"] + 1).otherwise(0)
        head = F.when(err & (acc["head"] == acc["n"]), acc["n"] + 1).otherwise(acc["head"])
        return state(acc["n"] + 1, head, tail, F.greatest(acc["best"], tail))

    def merge(a, b):
        head = F.when(a["head"] == a["n"], a["n"] + b["head"]).otherwise(a["head"])
        tail = F.when(b["tail"] == b["n"], a["tail"] + b["n"]).otherwise(b["tail"])
        return state(a["n"] + b["n"], head, tail,
                     F.greatest(a["best"], b["best"], a["tail"] + b["head"]))

    zero = F.lit(0)
    out = fold_events(log, layout, ["kind"], state(zero, zero, zero, zero), step, merge, fan)
    return out.select("user_id", F.col("acc.n").alias("n"), F.col("acc.best").alias("longest"))
