"""Timelines: incidents with the events around them, and the log seen as a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions import bucket_start, from_micros, micros
from tideline.operators.incidents import INCIDENT, is_error
from tideline.operators.normalise import KINDS, ORDER
from tideline.operators.ordered import Layout, Scan, scan, with_prior
from tideline.session import stage

PATH_PART = 1024


def incident_timeline(log: DataFrame, incidents: DataFrame, lead: str = "1 hour",
                      trail: str = "1 hour", gap: str = "24 hours") -> DataFrame:
    """All events of the entity in ``[start - lead, end + trail]``, both ends closed.

    Incidents are listed once per bucket they touch and events belong to one bucket, so the
    range join becomes an equi join on (user, bucket) with a residual test and no repeats.
    ``gap`` is that of the incidents: those of one user lie further apart, and a bucket is as
    wide as the gap or the reach around an incident, whichever is more, so an event meets few of
    them. A hot (user, bucket) is split by the adaptive skew join.
    """
    width = max(micros(gap), micros(lead) + micros(trail))
    first = bucket_start(F.col("start_us") - micros(lead), width)
    last = bucket_start(F.col("end_us") + micros(trail), width)
    spread = incidents.select(*INCIDENT, "start_ts", "end_ts", "start_us", "end_us",
                              F.explode(F.sequence(first, last, F.lit(width))).alias("_cell"))
    cells = log.withColumn("_cell", bucket_start(F.col("ts_us"), width))
    inside = ((F.col("ts_us") >= F.col("start_us") - micros(lead))
              & (F.col("ts_us") <= F.col("end_us") + micros(trail)))
    return (cells.join(spread, ["user_id", "_cell"]).where(inside)
            .withColumn("offset_us", F.col("ts_us") - F.col("start_us"))
            .select(*INCIDENT, "start_ts", "end_ts",
                    *[c for c in log.columns if c != "user_id"], "offset_us"))


def incident_summary(timeline: DataFrame) -> DataFrame:
    """Start, end, duration, events per kind and amount total of every incident."""
    return (timeline.groupBy(*INCIDENT, "start_ts", "end_ts")
            .agg(F.count("*").alias("n_events"),
                 *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
                 F.sum("amount").alias("amount"))
            .withColumn("duration_us", F.expr("timestampdiff(MICROSECOND, start_ts, end_ts)")))


def incident_path(timeline: DataFrame, part: int = PATH_PART) -> DataFrame:
    """Ordered kinds of an incident as a ``>``-joined string.

    Needs the replay number ``seq`` on the timeline. A long incident gives several rows, each
    with at most ``part`` events from its start on and its first ``seq``, so that no row or
    group is unbounded.
    """
    begin = timeline.groupBy(*INCIDENT).agg(F.min("seq").alias("_begin"))
    return (timeline.select(*INCIDENT, "seq", "kind").join(begin, INCIDENT)
            .withColumn("_part", F.expr(f"(seq - _begin) div {part}"))
            .groupBy(*INCIDENT, "_part")
            .agg(F.min("seq").alias("from_seq"), F.count("*").alias("n_events"),
                 F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("_events"))
            .select(*INCIDENT, "from_seq", "n_events",
                    F.array_join(F.transform("_events", lambda e: e["kind"]), ">")
                    .alias("path")))


def precursor_event(log: DataFrame, layout: Layout) -> DataFrame:
    """The last non-error event before each error of the same user (a backward as-of)."""
    calm = F.when(~is_error(), F.struct("event_id", "ts_us", "kind"))
    out = scan(log.select("event_id", "user_id", "ts", "ts_us", "kind"), ["user_id"], ORDER,
               {"_prior": Scan("last", calm, inclusive=False)}, layout)
    return out.where(is_error()).select(
        "event_id", "user_id", "ts", F.col("_prior.event_id").alias("prior_id"),
        F.col("_prior.kind").alias("prior_kind"),
        (F.col("ts_us") - F.col("_prior.ts_us")).alias("since_us"))


def error_rate_tumbling(log: DataFrame, width: str = "1 hour") -> DataFrame:
    return _rate(log.groupBy(F.window("ts", width).alias("w"))
                 .agg(F.count("*").alias("n_events"), F.count_if(is_error()).alias("n_errors"))
                 .select(F.col("w.start").alias("window_start"), "n_events", "n_errors"))


def error_rate_sliding(log: DataFrame, width: str = "1 hour",
                       slide: str = "15 minutes") -> DataFrame:
    """Overlapping windows. Events are counted per slide first; only those counts are copied
    into the windows, not the events. ``width`` must be a multiple of ``slide``."""
    step, size = micros(slide), micros(width)
    if size % step:
        raise ValueError("width must be a multiple of slide")
    counts = (log.groupBy(bucket_start(F.col("ts_us"), step).alias("_cell"))
              .agg(F.count("*").alias("n_events"), F.count_if(is_error()).alias("n_errors")))
    starts = F.sequence(F.col("_cell") - (size - step), F.col("_cell"), F.lit(step))
    return _rate(counts.withColumn("_start", F.explode(starts)).groupBy("_start")
                 .agg(F.sum("n_events").alias("n_events"), F.sum("n_errors").alias("n_errors"))
                 .select(from_micros(F.col("_start")).alias("window_start"),
                         "n_events", "n_errors"))


def _rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("error_share", F.col("n_errors") / F.col("n_events"))


def error_burst(log: DataFrame, layout: Layout, width: str = "1 hour", n: int = 3) -> DataFrame:
    """Events with at least ``n`` errors of the user in the trailing ``[ts - width, ts]``.

    A range frame would re-read its rows for every event and cannot be cut into runs. Instead:
    counts of errors per (user, cell of ``width``) rule out the cells in which no frame can
    reach ``n`` (events without a user count as those of one); for the events of the rest, the count is the difference of two running sums,
    read at ``ts`` and before ``ts - width`` by probe rows that travel along with the errors.
    """
    size = micros(width)
    slim = log.select(
        "event_id", "user_id", "ts_us", "kind",
        bucket_start(F.col("ts_us"), size).alias("_cell"))

    # A frame that ends in a cell lies in it and the one before.
    per_cell = slim.where(is_error()).groupBy("user_id", "_cell").agg(F.count("*").alias("_n"))
    two = F.array(F.col("_cell"), F.col("_cell") + size)
    busy = (per_cell.select("user_id", F.explode(two).alias("_cell"), "_n")
            .groupBy("user_id", "_cell").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= n))
    needed = busy.select("user_id", F.explode(F.array(
        F.struct(F.col("_cell").alias("c"), F.lit(1).alias("ends")),
        F.struct((F.col("_cell") - size).alias("c"), F.lit(0).alias("ends")))).alias("x"))
    needed = needed.groupBy("user_id", F.col("x.c").alias("_cell")).agg(
        F.max("x.ends").alias("_ends"))

    # side 0: before the errors at that time; 1: an error; 2: after them.
    at, none = F.col("ts_us"), F.lit(None).cast("long")
    needed = needed.select(F.col("user_id").alias("_user"), F.col("_cell").alias("_at"), "_ends")
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_cell") == F.col("_at"))
    rows = slim.join(needed, same).select("event_id", "user_id", "kind", F.explode(
        F.array(F.struct(F.when(F.col("_ends") == 1, at - size).alias("ts_us"),
                         F.lit(0).alias("side")),
                F.struct(F.when(is_error(), at).otherwise(none).alias("ts_us"),
                         F.lit(1).alias("side")),
                F.struct(F.when(F.col("_ends") == 1, at).alias("ts_us"),
                         F.lit(2).alias("side")))).alias("p")
    ).select("event_id", "user_id", "kind", "p.*").where("ts_us is not null")
    if not layout.flat:
        rows = stage(rows, "bursts")  # read twice by the scan over runs
    walk = scan(rows, ["user_id"], ["ts_us", "side", "event_id"],
                {"_errors": Scan("sum", (F.col("side") == 1).cast("long"))}, layout)
    signed = F.when(F.col("side") == 2, F.col("_errors")).otherwise(-F.col("_errors"))
    return (walk.where("side <> 1").groupBy("event_id", "user_id", "kind")
            .agg(F.max("ts_us").alias("ts_us"), F.sum(signed).alias("errors_in_width"))
            .where(F.col("errors_in_width") >= n)
            .select("event_id", "user_id", from_micros(F.col("ts_us")).alias("ts"), "kind",
                    "errors_in_width"))


def state_spans(log: DataFrame, layout: Layout) -> DataFrame:
    """Healthy / degraded / failed spans per user; a span ends where the next one starts.

    ``failed``: this and the previous event are errors; ``degraded``: only this one is.
    """
    slim = log.select("event_id", "user_id", "ts_us", is_error().alias("_err"))
    slim = with_prior(slim, "user_id", ORDER, {"_err_before": "_err"}, layout)
    # A healthy event after a healthy one starts nothing, and none of the others needs it.
    slim = slim.where("_err or _err_before or _err_before is null")
    if not layout.flat:
        slim = stage(slim, "spans")  # each scan over runs below reads its input twice
    state = (F.when(~F.col("_err"), "healthy")
             .when(F.coalesce("_err_before", F.lit(False)), "failed").otherwise("degraded"))
    states = slim.select("event_id", "user_id", "ts_us", state.alias("state"))
    states = with_prior(states, "user_id", ORDER, {"_state_before": "state"}, layout)
    starts = states.where(~F.col("state").eqNullSafe(F.col("_state_before")))
    spans = with_prior(starts, "user_id", ORDER, {"_end_us": "ts_us"}, layout, following=True)
    return spans.select("user_id", "state", F.col("event_id").alias("first_event_id"),
                        from_micros(F.col("ts_us")).alias("start_ts"),
                        from_micros(F.col("_end_us")).alias("end_ts"))


def event_transitions(log: DataFrame, layout: Layout) -> DataFrame:
    """Counts of (previous kind, kind) in the order of each user."""
    pairs = with_prior(log.select("event_id", "user_id", "ts_us", "kind"), "user_id", ORDER,
                       {"prior_kind": "kind"}, layout)
    return (pairs.where("prior_kind is not null").groupBy("prior_kind", "kind")
            .agg(F.count("*").alias("n")))


def daily_rollup(log: DataFrame) -> DataFrame:
    """Counts per day and kind, per day, and in total. Subtotals are built from the counts,
    so events are not multiplied by the number of grouping levels."""
    counts = log.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count("*").alias("c"))
    return counts.rollup("day", "kind").agg(
        F.sum("c").alias("n"), F.grouping_id().cast("long").alias("level"))


def timeline_grid(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Error counts per window with zero rows for silent ones."""
    size = micros(width)
    cells = (log.groupBy(bucket_start(F.col("ts_us"), size).alias("cell"))
             .agg(F.count_if(is_error()).alias("n_errors")))
    # Each window also stands for the silent ones up to the next; one row per window is ordered.
    until = F.coalesce(F.lead("cell").over(Window.orderBy("cell")) - size, F.col("cell"))
    return (cells.withColumn("_until", until)
            .select("cell", "n_errors",
                    F.explode(F.sequence("cell", "_until", F.lit(size))).alias("_at"))
            .select(from_micros(F.col("_at")).alias("window_start"),
                    F.when(F.col("_at") == F.col("cell"), F.col("n_errors"))
                    .otherwise(F.lit(0)).alias("n_errors")))
