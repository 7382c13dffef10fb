"""Streaming queries: the given log is replayed as a file stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import bucket_start, from_micros
from tideline.operators import timeline as tl
from tideline.plans.catalog import lines_of, log_of, observed_of, query, text
from tideline.session import configure, fresh_path
from tideline.sources import (admitted, quarantined, read_events, read_events_stream, read_table,
                              readmit)
from tideline.streaming import (deliver, drain, drain_batches, drain_lines, stream_dedupe, stream_enrich,
                                stream_error_rate, stream_error_recovery, stream_incidents,
                                stream_period_state, stream_replay_state)

HOUR = 3_600_000_000

# The log comes in deliveries that cover equal stretches of its time. Some events
# come with the last one, however old.
DELIVERIES = 4
STRAGGLERS = "event_id % 53 = 11"


def stream_of(spark, sf_dir) -> DataFrame:
    return read_events_stream(configure(spark), f"{sf_dir}/events.parquet")


def delivery_of(events: DataFrame, stragglers: bool) -> str:
    """The number of each event's delivery as an expression, for a log of any length."""
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                           F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    span = max(1, (high or 0) - (low or 0) + 1)
    part = f"cast((unix_micros(cast(ts as timestamp)) - {low or 0}) * {DELIVERIES} div {span} as int)"
    return f"if({STRAGGLERS}, {DELIVERIES - 1}, {part})" if stragglers else part


def delivered(spark, sf_dir, stragglers: bool, build, run, path: str | None = None) -> DataFrame:
    """Deliver the log part by part; the stream is restarted from its checkpoint each time."""
    root, path = fresh_path(spark, "arrivals"), path or fresh_path(spark, "stream")
    events = read_events(configure(spark), sf_dir)
    part = delivery_of(events, stragglers)
    out = None
    for number in range(DELIVERIES):
        deliver(events, part, root, number)
        stream = read_events_stream(spark, f"{root}/delivery-*", glob="*.parquet")
        out = run(build(stream), path)
    return out


@query
def read_events_stream_(spark, sf_dir):
    """The log through the file stream, unchanged."""
    stream = stream_of(spark, sf_dir)
    return drain(stream.withColumn("ts", F.col("ts").cast("timestamp_ntz")))[0]


@query
def stream_error_rate_(spark, sf_dir):
    return drain(stream_error_rate(stream_of(spark, sf_dir)))[0]


@query
def stream_incidents_(spark, sf_dir):
    return drain(stream_incidents(stream_of(spark, sf_dir)))[0]


@query
def stream_dedupe_(spark, sf_dir):
    """The faulty log as a stream; repeats arrive in the same delivery."""
    root = fresh_path(configure(spark), "observed")
    seen = observed_of(spark, sf_dir)
    seen.select("event_id", "ts", "user_id", F.col("kind").alias("event_type"),
                F.col("amount").cast("double").alias("value"),
                F.lit(None).cast("string").alias("props")).write.parquet(root)
    out = stream_dedupe(read_events_stream(spark, root, glob="*.parquet"))
    return drain(out.select("event_id", "user_id", "event_type", "value"))[0]


@query
def stream_replay_state_(spark, sf_dir):
    """State after every event that the watermark has passed."""
    return text(drain(stream_replay_state(stream_of(spark, sf_dir)))[0], "amount")


@query
def stream_period_state_(spark, sf_dir):
    return text(drain(stream_period_state(stream_of(spark, sf_dir)))[0], "amount")


@query
def stream_quarantine(spark, sf_dir):
    """The log as a text stream with broken lines; lines without a user are mended afterwards."""
    root, path = fresh_path(configure(spark), "lines"), fresh_path(spark, "sorted")
    lines_of(read_events(spark, sf_dir)).write.text(root)
    lines = spark.readStream.text(root).withColumnRenamed("value", "line")
    drain_lines(lines, path)
    readmit(spark, f"{path}/data", lambda line: F.when(
        ~line.contains('"user_id"'), F.regexp_replace(line, r"^\{", '{"user_id":-1,')).otherwise(line))
    number = F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("long").alias("event_id")
    return admitted(spark, f"{path}/data").select("event_id", "user_id", F.lit("ok").alias("reason")).unionByName(
        quarantined(spark, f"{path}/data").select(number, F.lit(None).cast("long").alias("user_id"), "reason"))


def late_cells(spark, sf_dir) -> DataFrame:
    """Events per delivery (``_part``) and hour (``_cell``), and whether they are ``_late``: their
    hour had closed before their delivery, by the latest time of the deliveries before it."""
    log = log_of(spark, sf_dir).select(
        "ts_us", bucket_start(F.col("ts_us"), HOUR).alias("_cell"),
        F.expr(delivery_of(read_events(spark, sf_dir), True)).alias("_part"))
    cells = log.groupBy("_part", "_cell").agg(F.count("*").alias("n"),
                                              F.max("ts_us").alias("max_us"))
    # One row per delivery.
    tops = cells.groupBy("_part").agg(F.max("max_us").alias("top"))
    later = F.filter(F.array(*[F.lit(i) for i in range(DELIVERIES)]),
                     lambda i: i > F.col("_part"))
    before = (tops.select(F.explode(later).alias("_part"), "top")
              .groupBy("_part").agg((F.max("top") - HOUR).alias("mark")))
    late = F.coalesce(F.col("_cell") + HOUR <= F.col("mark"), F.lit(False))
    return cells.join(before, "_part", "left").withColumn("_late", late)


@query
def stream_late_audit(spark, sf_dir):
    """Per hour: events in the log, events the stream counted, and events that came too late.
    The three numbers must add up for every closed hour."""
    streamed = delivered(spark, sf_dir, True, stream_error_rate,
                         lambda out, path: drain(out, path)[0])
    audit = (late_cells(spark, sf_dir).groupBy("_cell")
             .agg(F.sum("n").alias("n_events"),
                  F.coalesce(F.sum(F.when(F.col("_late"), F.col("n"))), F.lit(0)).alias("n_late"))
             .withColumn("window_start", from_micros(F.col("_cell"))))
    counted = streamed.select("window_start", F.col("n_events").alias("n_counted"))
    return counted.join(audit, "window_start", "left").select(
        "window_start", "n_events", "n_counted", "n_late",
        (F.col("n_events") == F.col("n_counted") + F.col("n_late")).alias("ok"))


@query
def stream_batch_parity(spark, sf_dir):
    """Closed hours of the stream next to the same hours of the batch result."""
    live = drain(stream_error_rate(stream_of(spark, sf_dir)))[0]
    batch = tl.error_rate_tumbling(log_of(spark, sf_dir)).select(
        "window_start", F.col("n_events").alias("b_events"), F.col("n_errors").alias("b_errors"))
    return live.join(batch, "window_start", "left").select(
        "window_start", "n_events", "n_errors",
        (F.col("n_events").eqNullSafe(F.col("b_events"))
         & F.col("n_errors").eqNullSafe(F.col("b_errors"))).alias("ok"))


@query
def stream_restart(spark, sf_dir):
    """Four deliveries in time order, a restart from the checkpoint after each."""
    return delivered(spark, sf_dir, False, stream_error_rate, drain_batches)


def open_windows(spark, path: str) -> DataFrame:
    """The windows that a stream of ``stream_error_rate`` holds in its state: read from the store."""
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    window = state.schema["key"].dataType.names[0]
    counts = F.col("value").cast("struct<n_events:bigint,n_errors:bigint>")  # both are called count there
    return state.select(F.col(f"key.{window}.start").cast("timestamp_ntz").alias("window_start"), counts.alias("c")).select(
        "window_start", "c.*")


@query
def stream_open_windows(spark, sf_dir):
    """What the state holds after four deliveries and restarts, next to the open hours of the log."""
    path = fresh_path(configure(spark), "stream")
    delivered(spark, sf_dir, False, stream_error_rate, drain_batches, path)
    batch = tl.error_rate_tumbling(log_of(spark, sf_dir)).select(
        "window_start", F.col("n_events").alias("b_events"), F.col("n_errors").alias("b_errors"))
    return open_windows(spark, path).join(batch, "window_start", "left").select(
        "window_start", "n_events", "n_errors",
        (F.col("n_events").eqNullSafe(F.col("b_events")) & F.col("n_errors").eqNullSafe(F.col("b_errors"))).alias("ok"))


@query
def stream_late_metric(spark, sf_dir):
    """Per delivery: events that arrived, as the stream observed them; that went out in closed hours;
    that the state holds. The rest was dropped, which the listing of late events must equal, and
    Spark's own metric must say whether there were any."""
    path, runs = fresh_path(configure(spark), "stream"), []

    def build(stream):
        return stream_error_rate(stream.observe("arrived", F.count(F.lit(1)).alias("n")))

    def run(out, path):
        done, query = drain(out, path)
        seen = [p for p in query.recentProgress]
        emitted, held = [df.agg(F.coalesce(F.sum("n_events"), F.lit(0))).first()[0]
                         for df in (done, open_windows(spark, path))]
        before = runs[-1] if runs else {"all": 0, "n_open": 0}
        arrived = sum(p.observedMetrics["arrived"]["n"] or 0 for p in seen if "arrived" in p.observedMetrics)
        runs.append({
            "delivery": len(runs), "n_arrived": arrived, "n_emitted": emitted - before["all"], "n_open": held,
            "n_dropped": before["n_open"] + arrived - (emitted - before["all"]) - held, "all": emitted,
            "told": any(o.numRowsDroppedByWatermark > 0 for p in seen for o in p.stateOperators)})
        return done

    delivered(spark, sf_dir, True, build, run, path)
    # one row per delivery
    counted = spark.createDataFrame([tuple(r[k] for k in (
        "delivery", "n_arrived", "n_emitted", "n_open", "n_dropped", "told")) for r in runs],
        "delivery int, n_arrived long, n_emitted long, n_open long, n_dropped long, told boolean")
    listed = late_cells(spark, sf_dir).groupBy(F.col("_part").alias("delivery")).agg(
        F.coalesce(F.sum(F.when(F.col("_late"), F.col("n"))), F.lit(0)).alias("n_listed"))
    ok = (F.col("n_dropped") == F.col("n_listed")) & (F.col("told") == (F.col("n_listed") > 0))
    return counted.join(listed, "delivery").select(*counted.columns[:-1], "n_listed", ok.alias("ok"))


@query
def stream_error_recovery_(spark, sf_dir):
    return drain(stream_error_recovery(stream_of(spark, sf_dir)))[0]


@query
def stream_enrich_(spark, sf_dir):
    out = stream_enrich(stream_of(spark, sf_dir), read_table(spark, sf_dir, "customer"))
    return drain(out.select("event_id", "user_id", "ts", "event_type", "segment"))[0]
