"""Streams against batch results, late data, restarts, and a failure in the middle of a batch."""

import pytest
from pyspark.sql import functions as F

from compare import rows_of_spark
from tideline.operators import Layout, normalise as norm, replay_running_state, timeline as tl
from tideline.sources import idempotent_sink, read_batches, read_events, read_events_stream
from tideline.streaming import (LateRows, deliver, drain, drain_batches, stream_dedupe,
                                stream_enrich, stream_error_rate, stream_error_recovery,
                                stream_period_state, stream_replay_state)
from tideline.streaming.ordered import GROUPS

SF = "/root/testdata/sf0.001"


def arrivals(spark, root):
    return read_events_stream(spark, f"{root}/delivery-*", glob="*.parquet")


def test_sliding_windows_match_batch(spark):
    live = drain(stream_error_rate(read_events_stream(spark, f"{SF}/events.parquet"), "1 hour", "15 minutes"))[0]
    batch = tl.error_rate_sliding(norm.canonical_events(read_events(spark, SF)))
    end = batch.agg(F.max("window_start")).first()[0]
    mark = read_events(spark, SF).agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    closed = batch.drop("error_share").where(
        F.col("window_start") + F.expr("interval 1 hour") <= F.lit(mark).cast("timestamp_ntz"))
    assert end is not None and rows_of_spark(live) == rows_of_spark(closed)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    events, root = read_events(spark, SF), str(tmp_path / "in")
    part = "if(event_id % 10 = 1, 1, 0)"
    deliver(events, part, root, 0)
    with LateRows(spark) as late:
        drain(stream_error_rate(arrivals(spark, root)), str(tmp_path / "out"))
    assert late.dropped == 0
    deliver(events, part, root, 1)
    with LateRows(spark) as late:
        out, _ = drain(stream_error_rate(arrivals(spark, root)), str(tmp_path / "out"))
    assert late.dropped > 0
    assert out.agg(F.sum("n_events")).first()[0] < events.count()


def test_failure_before_commit_loses_and_repeats_nothing(spark, tmp_path):
    events, root, path = read_events(spark, SF), str(tmp_path / "in"), str(tmp_path / "out")
    deliver(events, "day(ts) div 16", root, 0)
    drain_batches(stream_error_rate(arrivals(spark, root)), path)
    deliver(events, "day(ts) div 16", root, 1)

    def fail(batch_id):
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        drain_batches(stream_error_rate(arrivals(spark, root)), path, before_commit=fail)
    got = drain_batches(stream_error_rate(arrivals(spark, root)), path)
    want = drain(stream_error_rate(read_events_stream(spark, f"{SF}/events.parquet")))[0]
    assert rows_of_spark(got) == rows_of_spark(want)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    events, root, path = read_events(spark, SF), str(tmp_path / "in"), str(tmp_path / "out")
    for number in (0, 1):
        deliver(events, "day(ts) div 16", root, number)
        got = drain(stream_period_state(arrivals(spark, root)), path)[0]
    want = drain(stream_period_state(read_events_stream(spark, f"{SF}/events.parquet")))[0]
    assert rows_of_spark(got) == rows_of_spark(want)


CLOSING = "2024-03-01 00:00:00"


def disordered(spark, tmp_path, build):
    """The log in five deliveries, up to three days out of order, and an event that closes it all.
    The result, the log, and the checkpoint."""
    events, root, path = read_events(spark, SF), str(tmp_path / "in"), str(tmp_path / "out")
    late = F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int")
    arrives = F.greatest(F.lit(0), F.least(F.lit(4), F.floor((F.dayofmonth("ts") + late) / 7))).cast("int")
    events = events.withColumn("part", arrives).withColumn("event_id", F.expr("if(event_id % 50 = 3, null, event_id)"))
    out = None
    for number in range(5):
        deliver(events.where(F.col("part") == number).drop("part"), "0", f"{root}/{number}", 0)
        out = drain(build(read_events_stream(spark, f"{root}/*/delivery-*", glob="*.parquet")), path)[0]
    last = events.limit(1).drop("part").withColumns({
        "ts": F.expr(f"timestamp_ntz'{CLOSING}'"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit("error")})
    deliver(last, "0", f"{root}/5", 0)
    out = drain(build(read_events_stream(spark, f"{root}/*/delivery-*", glob="*.parquet")), path)[0]
    return out, norm.canonical_events(events), f"{path}/checkpoint"


def waiting(spark, checkpoint):
    """Timers and waiting rows in the state store, by user."""
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(checkpoint)
    rows = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return [[r[0] for r in df.select("key.user_id").distinct().collect()] for df in (timers, rows)]


def test_disordered_events_are_replayed_in_order(spark, tmp_path):
    out, log, checkpoint = disordered(spark, tmp_path, lambda s: stream_replay_state(s, "4 days"))
    want = replay_running_state(log, Layout("user_id"))
    assert rows_of_spark(out) == rows_of_spark(want.select(*out.columns))
    assert waiting(spark, checkpoint) == [[-1], [-1]]


def test_disordered_recoveries_are_found(spark, tmp_path):
    out, log, checkpoint = disordered(spark, tmp_path, lambda s: stream_error_recovery(s, "20 hours", "4 days"))
    errors = log.where("kind = 'error'").select("user_id", "ts").distinct()
    calm = log.where("kind <> 'error'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    reach = F.col("ts") + F.expr("interval 20 hours")
    want = errors.join(calm, (F.col("u") == F.col("user_id")) & (F.col("t") > F.col("ts")) & (F.col("t") <= reach), "left").groupBy(
        "user_id", F.col("ts").alias("error_ts")).agg(F.min("t").alias("recovered_ts"))
    assert rows_of_spark(out) == rows_of_spark(want)
    assert waiting(spark, checkpoint) == [[-1], [-1]]


def test_missing_times_users_and_amounts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", None, "view", 2.0), (2, "2024-01-01 00:00:01", None, None, None),
            (3, None, 5, "view", 1.0), (None, "2024-01-01 00:00:01", None, "error", 1.0), (4, "2024-01-02 00:00:00", 5, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "'{}' props").write.parquet(
        str(tmp_path / "events.parquet"))
    out = drain(stream_replay_state(read_events_stream(spark, str(tmp_path / "events.parquet"))))[0]
    assert sorted([(r.n, r.event_id, float(r.amount), r.last_kind, r.user_id) for r in out.collect()]) == [
        (1, 1, 2.0, "view", None), (2, None, 3.0, "error", None), (3, 2, 3.0, None, None)]


def test_a_count_of_late_rows_that_is_not_complete_fails(spark):
    with pytest.raises(TimeoutError):
        with LateRows(spark, timeout=0.1) as late:
            late._open = 1


def test_dedupe_drops_copies_across_deliveries(spark, tmp_path):
    events, root = read_events(spark, SF).where("event_id < 20"), str(tmp_path / "in")
    nameless = events.limit(3).withColumn("event_id", F.lit(None).cast("long"))
    nameless.write.parquet(f"{root}/delivery-9")
    many = events.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("_c")
    out = None
    for number in (0, 1):
        many.write.parquet(f"{root}/delivery-{number}")
        out = drain(stream_dedupe(arrivals(spark, root), "30 days", salts=4),
                    str(tmp_path / "out"))[0]
    ids = [r.event_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(20)) and ids.count(None) == 3


def test_sink_replaces_a_retried_batch(spark, tmp_path):
    path, df = str(tmp_path / "sink"), spark.range(5).toDF("id")
    for batch in (0, 1, 1):
        idempotent_sink(df, batch, path)
    assert read_batches(spark, path, df.schema).count() == 10


def test_files_and_their_order_do_not_matter(spark, tmp_path):
    """One file, a folder of four, and 120 files in mixed order of time."""
    log = read_events(spark, SF)
    log.repartition(4).write.parquet(str(tmp_path / "four" / "events.parquet"))
    log.repartition(120, F.xxhash64("event_id")).write.parquet(str(tmp_path / "many" / "events.parquet"))
    want = rows_of_spark(drain(stream_error_rate(read_events_stream(spark, f"{SF}/events.parquet")))[0])
    for name in ("four", "many"):
        stream = read_events_stream(spark, str(tmp_path / name / "events.parquet"))
        assert rows_of_spark(drain(stream_error_rate(stream))[0]) == want


def test_recovery_is_found_per_error(spark, tmp_path):
    """Recoveries within a period, in a later one, too late, and none."""
    rows = [(1, "00:01:05", "error"), (1, "00:01:05.5", "view"), (1, "00:01:20", "error"), (1, "00:01:40", "error"),
            (1, "00:20:00", "click"), (2, "00:30:00", "error"), (2, "01:30:00.000001", "view"), (3, "00:00:00", "view"),
            (3, "00:00:00", "error"), (4, "12:00:00", "view"), (4, "12:00:00", "error")]
    df = spark.createDataFrame([(k, f"2024-01-01 {t}", u, kind) for k, (u, t, kind) in enumerate(rows)],
                               "event_id long, ts string, user_id long, event_type string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "cast(1 as double) value", "'{}' props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = read_events_stream(spark, str(tmp_path / "events.parquet"))
    got = sorted((r.user_id, str(r.error_ts)[11:], r.recovered_ts and str(r.recovered_ts)[11:])
                 for r in drain(stream_error_recovery(stream))[0].collect())
    assert got == [(1, "00:01:05", "00:01:05.500000"), (1, "00:01:20", "00:20:00"), (1, "00:01:40", "00:20:00"),
                   (2, "00:30:00", None), (3, "00:00:00", None)]


def test_enrich_never_broadcasts_the_repeated_side(spark, tmp_path, capsys):
    events = read_events(spark, SF).limit(200)
    events.unionByName(events.limit(1).withColumns({"user_id": F.lit(None).cast("long"), "event_id": F.lit(-1).cast("long")})).write.parquet(
        str(tmp_path / "events.parquet"))
    customer = spark.createDataFrame([(1, "A"), (2, "B"), (2, "C"), (None, "D")], "c_custkey long, c_mktsegment string")
    out = stream_enrich(read_events_stream(spark, str(tmp_path / "events.parquet")), customer)
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = spark.read.parquet(str(tmp_path / "events.parquet")).join(customer, F.col("user_id") == F.col("c_custkey"), "left")
    names = ["event_id", "user_id", "ts", "c_mktsegment"]
    assert rows_of_spark(drain(out)[0].select(*names[:3], F.col("segment").alias("c_mktsegment"))) == rows_of_spark(want.select(*names))


def test_recoveries_of_many_users_share_state(spark, tmp_path):
    """Users of one key keep their events apart; the state has a bounded number of keys a day."""
    users = [*range(-600, 1400), 2**62 + 1, 2**62 + 1 + GROUPS, None]
    rows = [(u, f"2024-01-01 00:{(u or 0) % 7:02}:{s:02}", kind) for u in users
            for s, kind in ((0, "error"), (0, "view"), (0, "error"), ((u or 0) % 3 * 9 + 1, "view"), (50, "error"))]
    rows += [(u, "2024-01-01 05:00:00", "view") for u in users]

    def write(rows, name):
        spark.createDataFrame(rows, "user_id long, ts string, event_type string").selectExpr(
            "cast(1 as bigint) event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "cast(1 as double) value",
            "'{}' props").write.parquet(str(tmp_path / "in" / name))

    write(rows, "0")
    path = str(tmp_path / "out")
    stream = read_events_stream(spark, str(tmp_path / "in" / "*"), glob="*.parquet")
    got = drain(stream_error_recovery(stream), path)[0]
    want = []
    for u in users:
        at = f"00:{(u or 0) % 7:02}:"
        want += [(u, f"{at}00", f"{at}{(u or 0) % 3 * 9 + 1:02}"), (u, f"{at}50", None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    seen = sorted([(r.user_id, str(r.error_ts)[11:], r.recovered_ts and str(r.recovered_ts)[11:]) for r in got.collect()], key=key)
    assert seen == sorted(want, key=key)
    waits = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{path}/checkpoint")
    assert waits.select("key").distinct().count() <= 2 * GROUPS  # remainders of either sign, and null
