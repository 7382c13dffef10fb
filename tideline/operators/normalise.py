"""Preparing a log: canonical form, repeats, order, slices, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions import bucket_start, micros, micros_of
from tideline.operators.ordered import ROWS_PER_RUN, FixedRuns, Layout, Scan, ranged, scan

# The kinds of event in the log.
KINDS = ["click", "error", "purchase", "signup", "view"]

ORDER = ("ts_us", "event_id")

SEQUENCE_RUN = 1_000_000


def canonical_events(events: DataFrame) -> DataFrame:
    """Raw events as the canonical log: decimal amount, ``ts_us``, payload field ``k``."""
    return events.select(
        "event_id", "user_id", "ts", micros_of("ts").alias("ts_us"),
        F.col("event_type").alias("kind"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def dedupe_events(df: DataFrame, key: str = "event_id",
                  order: Sequence[str] = ("ts_us", "user_id", "kind", "amount", "k")) -> DataFrame:
    """Keep the first row per ``key`` in ``order``; rows without a key are no repeats and stay.

    Written as ``row_number() = 1``, which Spark limits before the shuffle: every map task
    sends at most one row per key, however many copies of it there are. With an arrival column
    in ``order``, the copy that came first stays.
    """
    numbered = df.withColumn("_nameless", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    window = Window.partitionBy(key, "_nameless").orderBy(*order)
    return (numbered.withColumn("_rank", F.row_number().over(window)).where("_rank = 1")
            .drop("_rank", "_nameless"))


def total_order(df: DataFrame, layout: Layout, entity: str = "user_id") -> DataFrame:
    """Gap-free replay number ``seq`` per entity, from 1."""
    return scan(df, [entity], ORDER, {"seq": Scan("sum", F.lit(1).cast("long"))}, layout)


def out_of_order_audit(df: DataFrame, arrival: str = "arrival", lateness: str = "1 hour",
                       rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Events older than one that arrived before them, and by how much.

    ``arrival`` is a number or a time of any distribution: missing, tied and clustered values are
    as good as others. Rows without one come first; of one arrival, ``event_id`` and then the time
    of the event decide. The running maximum is global: a log of more than ``rows_per_run`` rows
    is cut into sampled ranges, and one row per range goes through an unpartitioned window.
    """
    out = scan(df, [], [arrival, "event_id", "ts_us"],
               {"max_us": Scan("max", F.col("ts_us"), inclusive=False)}, ranged(df, rows_per_run))
    late = F.col("max_us") - F.col("ts_us")
    return out.where("ts_us < max_us").select(
        "event_id", "user_id", "ts", arrival, late.alias("late_us"),
        (late > micros(lateness)).alias("beyond_lateness"))


def sequence_gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Missing ranges of an explicit sequence number per key.

    Copies are merged map-side first; then a run of numbers holds at most its width in rows.
    """
    distinct = (df.select(key, seq).where(F.col(key).isNotNull() & F.col(seq).isNotNull())
                .distinct())
    out = scan(distinct, [key], [seq],
               {"_before": Scan("max", F.col(seq), inclusive=False)},
               FixedRuns(seq, SEQUENCE_RUN))
    return out.where(F.col(seq) - F.col("_before") > 1).select(
        key, (F.col("_before") + 1).alias("missing_from"), (F.col(seq) - 1).alias("missing_to"),
        (F.col(seq) - F.col("_before") - 1).alias("missing"))


def duplicate_report(df: DataFrame, key: str = "event_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def replay_slice(df: DataFrame, start: str | None = None, end: str | None = None,
                 kinds: Sequence[str] | None = None,
                 entities: DataFrame | Sequence[int] | None = None,
                 entity: str = "user_id") -> DataFrame:
    """Events in ``[start, end)`` of the given kinds and entities.

    Conditions are on stored columns, so they reach the Parquet scan. A DataFrame of entities
    is a semi join, for lists too long to write out.
    """
    if start is not None:
        df = df.where(F.col("ts") >= F.expr(f"timestamp_ntz'{start}'"))
    if end is not None:
        df = df.where(F.col("ts") < F.expr(f"timestamp_ntz'{end}'"))
    if kinds is not None:
        df = df.where(F.col("kind").isin(*kinds))
    if isinstance(entities, DataFrame):
        return df.join(entities.select(entity), entity, "left_semi")
    if entities is not None:
        df = df.where(F.col(entity).isin(*entities))
    return df


def enrich_entity(df: DataFrame, customer: DataFrame, nation: DataFrame,
                  region: DataFrame) -> DataFrame:
    """Attach segment, nation and region; events of unknown entities are kept.

    The dimensions are joined to each other first. The customer side grows with the data, so
    it carries no broadcast hint: its size at run time decides, and a hot entity is split by
    the adaptive skew join.
    """
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    who = (customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
           .select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
                   F.col("n_name").alias("nation"), F.col("r_name").alias("region")))
    return df.join(who, "user_id", "left")


def with_bucket(df: DataFrame, width: int, at: str = "ts_us", name: str = "bucket") -> DataFrame:
    return df.withColumn(name, bucket_start(F.col(at), width))
