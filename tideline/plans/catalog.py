"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``.

Amounts and wide digests are returned as text, so that other engines can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.operators import incidents as inc
from tideline.operators import normalise as norm
from tideline.operators import recovery as rec
from tideline.operators import replay as rep
from tideline.operators import sweep
from tideline.operators import timeline as tl
from tideline.operators import tree
from tideline.operators import validate as val
from tideline.operators.failures import fail_first_attempts
from tideline.operators.ordered import Layout, measure
from tideline.session import configure, fresh_path, stage
from tideline.sources import (idempotent_sink, observed_log, parse_quarantine, read_batches,
                              read_events, read_table, with_arrival, write_dated, write_timeline)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Cut times and slices used by the queries and by their SQL.
CUT = "2024-01-15 00:00:00"
SLICE = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")
CUTS = ("2024-01-10 00:00:00", "2024-01-11 00:00:00", "2024-01-13 12:00:00")
FAULTS_UNTIL = "2024-01-08 00:00:00"
CHAIN_FAN = 64


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing ``_`` only avoids a clash of names."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.canonical_events(read_events(configure(spark), sf_dir))


def layout_of(spark: SparkSession, sf_dir: str) -> Layout:
    return measure(log_of(spark, sf_dir))


def text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def incidents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.detect_incidents(log_of(spark, sf_dir))


def observed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_log(log_of(spark, sf_dir))


def timeline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return tl.incident_timeline(log, inc.detect_incidents(log))


# --- sources and sinks -------------------------------------------------------------------


@query
def read_events_(spark, sf_dir):
    return read_events(configure(spark), sf_dir)


def lines_of(raw: DataFrame) -> DataFrame:
    json = F.to_json(F.struct("event_id", "ts", F.expr(
        "if(event_id % 50 = 2, null, user_id)").alias("user_id"), "event_type", "value",
        "props"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return raw.select(F.when(F.col("event_id") % 50 == 1, F.substring(json, 1, 30))
                      .otherwise(json).alias("line"))


@query
def parse_quarantine_(spark, sf_dir):
    """Events as JSON lines, every 50th cut short and every 50th without its entity."""
    raw = read_events(configure(spark), sf_dir)
    good, bad = parse_quarantine(lines_of(raw))
    return (good.select("event_id", F.lit("ok").alias("reason"))
            .unionByName(bad.select(
                F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"),
                "reason")))


@query
def write_timeline_(spark, sf_dir):
    path = fresh_path(configure(spark), "timeline")
    write_timeline(timeline_of(spark, sf_dir), path)
    return text(spark.read.parquet(path).select(
        "incident_date", "user_id", "incident_no", "event_id", "amount", "offset_us"), "amount")


@query
def idempotent_sink_(spark, sf_dir):
    """Two batches, the second delivered twice."""
    path = fresh_path(configure(spark), "batches")
    log = log_of(spark, sf_dir).select("event_id", "user_id", "kind")
    for batch, rest in ((0, 0), (1, 1), (1, 1)):
        idempotent_sink(log.where(F.col("event_id") % 2 == rest), batch, path)
    return read_batches(spark, path, log.schema)


# --- normalisation -----------------------------------------------------------------------


@query
def canonical_events(spark, sf_dir):
    return text(log_of(spark, sf_dir), "amount")


@query
def dedupe_events(spark, sf_dir):
    return text(norm.dedupe_events(observed_of(spark, sf_dir)), "amount")


@query
def total_order(spark, sf_dir):
    return norm.total_order(log_of(spark, sf_dir), layout_of(spark, sf_dir)).select(
        "event_id", "user_id", "seq")


@query
def out_of_order_audit(spark, sf_dir):
    return norm.out_of_order_audit(with_arrival(log_of(spark, sf_dir)))


@query
def sequence_gaps(spark, sf_dir):
    turns = read_table(configure(spark), sf_dir, "conversations").where(
        "(conv_id * 31 + turn) % 7 <> 0")
    return norm.sequence_gaps(turns, "conv_id", "turn")


@query
def duplicate_report(spark, sf_dir):
    return norm.duplicate_report(observed_of(spark, sf_dir))


@query
def replay_slice(spark, sf_dir):
    who = read_table(configure(spark), sf_dir, "customer").where(
        "c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    out = norm.replay_slice(log_of(spark, sf_dir), *SLICE, kinds=["error", "purchase"],
                            entities=who)
    return text(out, "amount")


@query
def enrich_entity(spark, sf_dir):
    log = log_of(spark, sf_dir).select("event_id", "user_id", "kind")
    return norm.enrich_entity(log, *[read_table(spark, sf_dir, t)
                                     for t in ("customer", "nation", "region")])


# --- incidents and timelines -------------------------------------------------------------


@query
def detect_incidents(spark, sf_dir):
    return incidents_of(spark, sf_dir)


@query
def incident_sessions(spark, sf_dir):
    return inc.incident_sessions(log_of(spark, sf_dir))


@query
def incident_timeline(spark, sf_dir):
    return text(timeline_of(spark, sf_dir), "amount")


@query
def incident_summary(spark, sf_dir):
    return text(tl.incident_summary(timeline_of(spark, sf_dir)), "amount")


@query
def incident_path(spark, sf_dir):
    ordered = norm.total_order(log_of(spark, sf_dir), layout_of(spark, sf_dir))
    return tl.incident_path(tl.incident_timeline(ordered, incidents_of(spark, sf_dir)))


@query
def precursor_event(spark, sf_dir):
    return tl.precursor_event(log_of(spark, sf_dir), layout_of(spark, sf_dir))


@query
def time_to_recovery(spark, sf_dir):
    return inc.time_to_recovery(log_of(spark, sf_dir), incidents_of(spark, sf_dir))


@query
def merge_overlapping(spark, sf_dir):
    """Short gaps, so that the given log has more than one outage."""
    short = inc.detect_incidents(log_of(spark, sf_dir), "6 hours")
    return sweep.merge_overlapping(short, min_events=2)


@query
def concurrent_incidents(spark, sf_dir):
    return sweep.concurrent_incidents(incidents_of(spark, sf_dir))


@query
def error_rate_tumbling(spark, sf_dir):
    return tl.error_rate_tumbling(log_of(spark, sf_dir))


@query
def error_rate_sliding(spark, sf_dir):
    return tl.error_rate_sliding(log_of(spark, sf_dir))


@query
def error_burst(spark, sf_dir):
    """A window of a day: hourly bursts of three are too rare in the given log."""
    return tl.error_burst(log_of(spark, sf_dir), layout_of(spark, sf_dir), "1 day", 3)


@query
def state_spans(spark, sf_dir):
    return tl.state_spans(log_of(spark, sf_dir), layout_of(spark, sf_dir))


@query
def event_transitions(spark, sf_dir):
    return tl.event_transitions(log_of(spark, sf_dir), layout_of(spark, sf_dir))


@query
def daily_rollup(spark, sf_dir):
    return tl.daily_rollup(log_of(spark, sf_dir))


@query
def recovery_percentiles(spark, sf_dir):
    out = inc.recovery_percentiles(time_to_recovery(spark, sf_dir))
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


@query
def worst_incidents(spark, sf_dir):
    return inc.worst_incidents(incidents_of(spark, sf_dir))


@query
def timeline_grid(spark, sf_dir):
    return tl.timeline_grid(log_of(spark, sf_dir))


@query
def overlapping_incidents(spark, sf_dir):
    return sweep.overlapping_incidents(stage(incidents_of(spark, sf_dir), "incidents"))


# --- replay and recovery -----------------------------------------------------------------


@query
def replay_running_state(spark, sf_dir):
    return text(rep.replay_running_state(log_of(spark, sf_dir), layout_of(spark, sf_dir)),
                "amount")


@query
def replay_as_of(spark, sf_dir):
    return text(rep.replay_as_of(log_of(spark, sf_dir), CUT), "amount")


@query
def replay_final_state(spark, sf_dir):
    return text(rep.replay_final_state(log_of(spark, sf_dir)), "amount")


@query
def snapshots(spark, sf_dir):
    return text(rec.snapshots(log_of(spark, sf_dir)), "amount")


def stored_recovery(spark, log: DataFrame, path: str) -> DataFrame:
    """State recovered from the stored cut and the stored days after it."""
    write_dated(log, f"{path}/log")
    rec.extend_cuts(spark, f"{path}/cuts", f"{path}/log", log.schema, CUT)
    return rec.state_at(spark, f"{path}/cuts", f"{path}/log", log.schema)


@query
def recover_state(spark, sf_dir):
    return text(stored_recovery(spark, log_of(spark, sf_dir), fresh_path(spark, "stored")), "amount")


@query
def extended_snapshots(spark, sf_dir):
    """Three cuts, each extended from the one before by the days in between, and their states."""
    path, log = fresh_path(configure(spark), "stored"), log_of(spark, sf_dir)
    write_dated(log, f"{path}/log")
    out = []
    for cut in CUTS:
        rec.extend_cuts(spark, f"{path}/cuts", f"{path}/log", log.schema, cut)
        out.append(rec.read_cut(spark, f"{path}/cuts", cut).withColumn(
            "cut_ts", F.expr(f"timestamp_ntz'{cut}'")))
    return text(reduce(DataFrame.unionByName, out), "amount")


def points_of(spark, sf_dir):
    """Recovery to the start of each user's last incident."""
    log = log_of(spark, sf_dir)
    targets = inc.detect_incidents(log).groupBy("user_id").agg(
        F.max("start_ts").alias("target_ts"))
    return rec.recovery_point(rec.snapshots(log), targets)


@query
def recovery_point(spark, sf_dir):
    return text(points_of(spark, sf_dir), "amount")


@query
def tail_events(spark, sf_dir):
    return text(rec.tail_events(log_of(spark, sf_dir), points_of(spark, sf_dir)), "amount")


@query
def repair_log(spark, sf_dir):
    return text(rec.repair_log(log_of(spark, sf_dir), observed_of(spark, sf_dir)), "amount")


@query
def fold_events(spark, sf_dir):
    return rep.error_streaks(log_of(spark, sf_dir), layout_of(spark, sf_dir), CHAIN_FAN)


@query
def fold_events_py(spark, sf_dir):
    """Largest amount (in cents) spent by a user between two errors."""
    def fold(pdf: pd.DataFrame) -> dict:
        cents = (pdf["amount"] * 100).astype("int64")
        err = pdf["kind"] == "error"
        sums = cents.where(~err, 0).groupby(err.cumsum()).sum()
        return {"head": int(sums.iloc[0]) if not err.iloc[0] else 0, "tail": int(sums.iloc[-1]),
                "best": int(sums.max()), "errors": int(err.sum())}

    def merge(parts: list[dict]) -> dict:
        acc = dict(parts[0])
        for p in parts[1:]:
            joined = acc["tail"] + p["head"]
            acc = {"head": acc["head"] if acc["errors"] else joined,
                   "tail": p["tail"] if p["errors"] else joined,
                   "best": max(acc["best"], p["best"], joined),
                   "errors": acc["errors"] + p["errors"]}
        return acc

    shape = T.StructType([T.StructField(n, T.LongType())
                          for n in ("head", "tail", "best", "errors")])
    log = log_of(spark, sf_dir).select("event_id", "user_id", "ts_us", "kind", "amount")
    return rep.fold_events_py(log, layout_of(spark, sf_dir), fold, merge, shape).select(
        "user_id", "best", "errors")


# --- validation --------------------------------------------------------------------------


@query
def row_digest(spark, sf_dir):
    log = log_of(spark, sf_dir).withColumn("k", F.expr("if(k = 0, null, k)"))
    return val.row_digest(log, ["event_id", "user_id", "ts_us", "kind", "amount", "k"])


@query
def multiset_digest(spark, sf_dir):
    return text(val.multiset_digest(observed_of(spark, sf_dir), "user_id",
                                    ["event_id", *val.CONTENT]), "digest")


@query
def ordered_digest(spark, sf_dir):
    return text(val.ordered_digest(log_of(spark, sf_dir), layout_of(spark, sf_dir)), "digest")


@query
def hash_chain(spark, sf_dir):
    return rep.hash_chain(log_of(spark, sf_dir), layout_of(spark, sf_dir), fan=CHAIN_FAN)


@query
def reconcile_events(spark, sf_dir):
    return text(val.reconcile_events(log_of(spark, sf_dir), observed_of(spark, sf_dir)),
                "expected_amount", "observed_amount")


@query
def first_divergence(spark, sf_dir):
    return text(val.first_divergence(log_of(spark, sf_dir), observed_of(spark, sf_dir)),
                "expected_amount", "observed_amount")


@query
def determinism_check(spark, sf_dir):
    """With a flat layout and with one that cuts the busiest users into runs."""
    return determinism_of(log_of(spark, sf_dir))


def determinism_of(log: DataFrame) -> DataFrame:
    busiest = log.groupBy("user_id").count().agg(F.max("count")).first()[0] or 2
    return val.determinism_check(
        log, [Layout("user_id"), measure(log, rows_per_run=max(1, busiest - 1))],
        lambda df, layout: rep.hash_chain(df, layout, fan=CHAIN_FAN).withColumnRenamed(
            "chain", "digest"))


@query
def failure_check(spark, sf_dir):
    """The replay with and without failed attempts, where the session tries tasks again."""
    return val.determinism_check(
        log_of(spark, sf_dir), Layout("user_id"),
        lambda df, layout: rep.hash_chain(df, layout, fan=CHAIN_FAN).withColumnRenamed("chain", "digest"),
        {"as stored": lambda df: df, "failed attempts": fail_first_attempts})


@query
def idempotence_check(spark, sf_dir):
    return text(val.idempotence_check(log_of(spark, sf_dir)), "amount")


@query
def snapshot_check(spark, sf_dir):
    return text(val.snapshot_check(log_of(spark, sf_dir), CUT), "amount")


@query
def invariant_report(spark, sf_dir):
    """The standard rules, and one that the given log does break."""
    rules = {**val.RULES, "amount_over_50": "amount > 50"}
    return val.invariant_report(log_of(spark, sf_dir), read_table(spark, sf_dir, "customer"),
                                rules)


@query
def log_diff(spark, sf_dir):
    return text(val.log_diff(log_of(spark, sf_dir), observed_of(spark, sf_dir)), "amount")


def partly_observed(spark, sf_dir):
    """A copy of the log with faults in its first days only."""
    log = log_of(spark, sf_dir)
    return (norm.replay_slice(observed_log(log), end=FAULTS_UNTIL)
            .unionByName(norm.replay_slice(log, start=FAULTS_UNTIL)))


@query
def bucket_digests(spark, sf_dir):
    return text(val.bucket_digests(log_of(spark, sf_dir), partly_observed(spark, sf_dir))
                .drop("_cell"), "digest_a", "digest_b")


@query
def bucket_digest_diff(spark, sf_dir):
    return text(val.bucket_digest_diff(log_of(spark, sf_dir), partly_observed(spark, sf_dir)),
                "amount")


def trees_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    path = fresh_path(configure(spark), "trees")
    tree.store_tree(log_of(spark, sf_dir), f"{path}/a")
    tree.store_tree(partly_observed(spark, sf_dir), f"{path}/b")
    return tree.compare_trees(spark, f"{path}/a", f"{path}/b")


@query
def digest_tree_levels(spark, sf_dir):
    """Digests compared and found different on each level, from the months down."""
    return trees_of(spark, sf_dir)[0]


@query
def digest_tree_leaves(spark, sf_dir):
    return trees_of(spark, sf_dir)[1].select("day", "hour", "share")


@query
def validation_summary(spark, sf_dir):
    """Both logs are brought into canonical form and written once; all checks read that."""
    log = stage(log_of(spark, sf_dir), "log")
    observed = stage(observed_of(spark, sf_dir), "observed")
    return val.validation_summary({
        "determinism": determinism_of(log),
        "idempotence": val.idempotence_check(log),
        "snapshot": val.snapshot_check(log, CUT),
        "states": val.compare_states(rep.replay_final_state(log),
                                     rep.replay_final_state(norm.dedupe_events(observed))),
        "events": val.reconcile_events(log, observed).withColumn(
            "ok", F.col("status") == "match"),
    })
