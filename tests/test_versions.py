"""Published versions: sinks, cuts and quarantine, when writers fail half-way or are repeated."""

import pytest
from pyspark.sql import functions as F

from compare import rows_of_spark
from tideline.operators import canonical_events, cuts, extend_cuts, read_cut, replay_as_of, replay_final_state, state_at, withdraw_cuts
from tideline.sources import (admitted, clean, idempotent_sink, publish, published, quarantined, read_batches, read_events,
                              readmit, store_lines, withdraw, write_dated)
from tideline.sources import quarantine
from tideline.streaming import drain_lines

import tideline.sources.versions as versions

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(r[0] for r in df.collect())


def test_a_killed_attempt_is_never_read(spark, tmp_path):
    path, one = str(tmp_path), spark.range(0, 100, numPartitions=4)
    idempotent_sink(one, 7, path)
    before = read_batches(spark, path, one.schema)
    half = spark.range(0, 200, numPartitions=8).select(
        F.when(F.col("id") < 190, F.col("id") + 1000).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        idempotent_sink(half, 7, path)
    assert values(read_batches(spark, path, one.schema)) == list(range(100))
    idempotent_sink(one.select((F.col("id") + 5000).alias("id")), 7, path)
    assert values(read_batches(spark, path, one.schema)) == list(range(5000, 5100))
    assert values(before) == list(range(100))  # a reader that came earlier is not disturbed
    assert clean(spark, path) == 2 and clean(spark, path) == 0
    assert values(read_batches(spark, path, one.schema)) == list(range(5000, 5100))


def test_a_crash_before_the_marker_shows_the_old_version(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path), spark.range(3)
    idempotent_sink(df, 0, path)
    with monkeypatch.context() as m:
        m.setattr(versions, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        for batch in (0, 1):
            with pytest.raises(RuntimeError, match="crash"):
                idempotent_sink(spark.range(9), batch, path)
    assert values(read_batches(spark, path, df.schema)) == [0, 1, 2] and published(spark, path) == ["batch-0"]
    withdraw(spark, path, "batch-0")
    assert read_batches(spark, path, df.schema).count() == 0
    publish(df, path, "batch-0")
    assert values(read_batches(spark, path, df.schema)) == [0, 1, 2]


def test_no_batches_and_empty_ones(spark, tmp_path):
    df = spark.range(3)
    assert read_batches(spark, str(tmp_path / "none"), df.schema).count() == 0
    idempotent_sink(df.where("false"), 0, str(tmp_path / "some"))
    assert read_batches(spark, str(tmp_path / "some"), df.schema).count() == 0
    with pytest.raises(ValueError):
        publish(df, str(tmp_path), "a~b")


@pytest.fixture(scope="module")
def log(spark):
    return canonical_events(read_events(spark, SF))


def test_cuts_are_extended_by_the_days_between(spark, log, tmp_path):
    path, stored = str(tmp_path / "cuts"), str(tmp_path / "log")
    write_dated(log, stored)
    extend_cuts(spark, path, stored, log.schema, "2024-01-10")
    # from now on the older days are not there at all
    later = str(tmp_path / "later")
    write_dated(log.where("ts >= timestamp_ntz'2024-01-10'"), later)
    for cut in ("2024-01-11", "2024-01-12 06:30:00", "2024-01-20"):
        extend_cuts(spark, path, later, log.schema, cut)
        assert rows_of_spark(read_cut(spark, path, cut)) == rows_of_spark(replay_as_of(log, cut))
    assert [str(c) for c in cuts(spark, path)] == [
        "2024-01-10 00:00:00", "2024-01-11 00:00:00", "2024-01-12 06:30:00", "2024-01-20 00:00:00"]
    assert rows_of_spark(state_at(spark, path, later, log.schema)) == rows_of_spark(replay_final_state(log))
    assert rows_of_spark(state_at(spark, path, later, log.schema, "2024-01-15 12:00:00")) == rows_of_spark(
        replay_as_of(log, "2024-01-15 12:00:00"))
    # a day more reads a day
    plan = state_at(spark, path, later, log.schema, "2024-01-21")._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("event_date" in x and ">=" in x and "<=" in x for x in filters), filters


def test_a_crash_while_a_cut_is_stored_shows_the_old_one(spark, log, tmp_path, monkeypatch):
    path, stored = str(tmp_path / "cuts"), str(tmp_path / "log")
    write_dated(log, stored)
    extend_cuts(spark, path, stored, log.schema, "2024-01-10")
    with monkeypatch.context() as m:
        m.setattr(versions, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            extend_cuts(spark, path, stored, log.schema, "2024-01-11")
    assert len(cuts(spark, path)) == 1
    assert rows_of_spark(state_at(spark, path, stored, log.schema)) == rows_of_spark(replay_final_state(log))
    extend_cuts(spark, path, stored, log.schema, "2024-01-11")
    assert rows_of_spark(read_cut(spark, path, "2024-01-11")) == rows_of_spark(replay_as_of(log, "2024-01-11"))


def test_cuts_after_a_late_event_are_withdrawn_and_made_anew(spark, log, tmp_path):
    path, stored = str(tmp_path / "cuts"), str(tmp_path / "log")
    write_dated(log.where("event_id <> 100"), stored)
    for cut in ("2024-01-02", "2024-01-10", "2024-01-20"):
        extend_cuts(spark, path, stored, log.schema, cut)
    late = log.where("event_id = 100").first()
    write_dated(log.where(F.to_date("ts") == F.lit(late["ts"].date())), stored)  # its day is written anew
    withdraw_cuts(spark, path, str(late["ts"]))
    assert [str(c)[:10] for c in cuts(spark, path)] == ["2024-01-02"]
    extend_cuts(spark, path, stored, log.schema, "2024-01-20")
    assert rows_of_spark(read_cut(spark, path, "2024-01-20")) == rows_of_spark(replay_as_of(log, "2024-01-20"))
    assert rows_of_spark(state_at(spark, path, stored, log.schema)) == rows_of_spark(replay_final_state(log))


EVENT = '{"event_id":%d,"ts":"2024-01-01T00:00:00.5","user_id":1,"event_type":"view","value":1.5}'


def test_every_line_is_an_event_or_in_quarantine(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(number, lines):
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(f"{root}/d{number}")

    def run():
        drain_lines(spark.readStream.text(f"{root}/d*", pathGlobFilter="*.txt").withColumnRenamed("value", "line"), path)

    def counts():
        return admitted(spark, f"{path}/data").count(), quarantined(spark, f"{path}/data").count()

    arrive(0, [EVENT % 1, EVENT % 2, "{broken", '{"event_id":3}', ""])
    run()
    assert counts() == (2, 3)
    arrive(1, [EVENT % 4, EVENT % 4, "lost", '#' + EVENT % 5])
    real = versions._mark
    with monkeypatch.context() as m:  # the batch is published, then the driver is lost
        m.setattr(versions, "_mark", lambda *a: (real(*a), 1 / 0))
        with pytest.raises(Exception, match="division by zero"):
            run()
    run()
    assert counts() == (4, 5)
    for _ in range(2):
        readmit(spark, f"{path}/data", lambda line: F.ltrim(line, F.lit("#")))
        assert counts() == (5, 4)
    assert values(admitted(spark, f"{path}/data").select("event_id")) == [1, 2, 4, 4, 5]
    left = {(r["line"], r["reason"]) for r in quarantined(spark, f"{path}/data").collect()}
    assert left == {("{broken", "not an event"), ('{"event_id":3}', "no user_id"), ("", "not an event"), ("lost", "not an event")}


def test_a_batch_of_no_or_null_lines(spark, tmp_path):
    path = str(tmp_path)
    store_lines(spark.createDataFrame([], "line string"), 0, path)
    store_lines(spark.createDataFrame([(None,)], "line string"), 1, path)
    assert admitted(spark, path).count() == 0
    assert [tuple(r) for r in quarantined(spark, path).collect()] == [(None, "empty line")]
    readmit(spark, path, lambda line: line)
    assert quarantine.quarantined(spark, path).count() == 1 and published(spark, path) == ["batch-0", "batch-1"]
