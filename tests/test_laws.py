"""Laws that must hold, and faults that every check must report."""

import pytest
from pyspark.sql import functions as F

from compare import rows_of_spark
from tideline.operators import incidents as inc, normalise as norm, recovery as rec
from tideline.operators import replay as rep, sweep, timeline as tl, validate as val
from tideline.operators.ordered import measure
from tideline.plans.catalog import CUT
from tideline.sources import observed_log, parse_quarantine, read_events, with_arrival, write_timeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return norm.canonical_events(read_events(spark, SF)).cache()


@pytest.fixture(scope="module")
def layout(log):
    return measure(log)


def made(spark, rows):
    """(event_id, user_id, time, kind[, amount]) -> canonical log."""
    from decimal import Decimal
    df = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], Decimal(r[4] if len(r) > 4 else 1)) for r in rows],
        "event_id long, user_id long, t string, kind string, amount decimal(18,2)")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    from tideline.functions import micros_of
    return df.select("event_id", "user_id", "ts", micros_of("ts").alias("ts_us"), "kind",
                     "amount", F.lit(1).alias("k"))


def failed(df):
    return df.where(~F.col("ok")).count()


# --- incidents ---------------------------------------------------------------------------


def test_exact_gap_stays_together(spark):
    log = made(spark, [(1, 1, "2024-01-01 00:00:00", "error"),
                       (2, 1, "2024-01-01 01:00:00", "error"),
                       (3, 1, "2024-01-01 02:00:01", "error")])
    got = [(r.incident_no, r.n_errors) for r in
           inc.detect_incidents(log, "1 hour").orderBy("incident_no").collect()]
    assert got == [(1, 2), (2, 1)]
    assert sorted(r.n_errors for r in inc.incident_sessions(log, "1 hour").collect()) == [1, 2]


@pytest.mark.parametrize("gap", ["1 hour", "7 hours", "24 hours"])
def test_sessions_agree_with_islands(log, gap):
    cols = ["user_id", "start_ts", "end_ts", "n_errors"]
    a = inc.detect_incidents(log, gap).select(cols)
    b = inc.incident_sessions(log, gap).select(cols)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_incidents_before_1970(spark):
    log = made(spark, [(1, 1, "1969-12-31 23:30:00", "error"),
                       (2, 1, "1970-01-01 00:10:00", "error")])
    assert [(r.n_errors, str(r.start_ts)) for r in inc.detect_incidents(log, "1 hour").collect()] \
        == [(2, "1969-12-31 23:30:00")]


def test_min_events_keeps_numbers(log):
    every = {(r.user_id, r.incident_no): r.n_errors for r in inc.detect_incidents(log).collect()}
    some = {(r.user_id, r.incident_no): r.n_errors
            for r in inc.detect_incidents(log, min_events=3).collect()}
    assert some == {k: n for k, n in every.items() if n >= 3} and some


def test_touching_incidents_merge(spark):
    log = made(spark, [(1, 1, "2024-01-01 00:00:00", "error"),
                       (2, 1, "2024-01-01 01:00:00", "error"),
                       (3, 2, "2024-01-01 01:00:00", "error"),
                       (4, 2, "2024-01-01 02:00:00", "error"),
                       (5, 3, "2024-01-01 02:00:01", "error"),
                       (6, 3, "2024-01-01 02:30:00", "error")])
    out = sweep.merge_overlapping(inc.detect_incidents(log, "1 hour"), min_events=2)
    got = [(r.outage_no, str(r.start_ts), str(r.end_ts), r.n_incidents, r.n_errors)
           for r in out.orderBy("outage_no").collect()]
    assert got == [(1, "2024-01-01 00:00:00", "2024-01-01 02:00:00", 2, 4),
                   (2, "2024-01-01 02:00:01", "2024-01-01 02:30:00", 1, 2)]
    near = sweep.overlapping_incidents(inc.detect_incidents(log, "1 hour"))
    assert [r.n_overlapping for r in near.orderBy("user_id").collect()] == [1, 1, 0]


def test_outages_do_not_depend_on_the_runs(log, monkeypatch):
    short = inc.detect_incidents(log, "6 hours")
    one = sweep.merge_overlapping(short, 1).orderBy("outage_no").collect()
    monkeypatch.setattr(sweep, "MINUTE", 30 * inc.DAY)
    runs = sweep.merge_overlapping(short, 1).orderBy("outage_no").collect()
    assert one == runs and len(one) > 1


def test_last_boundary_leaves_nothing_open(log):
    out = sweep.concurrent_incidents(inc.detect_incidents(log))
    last = out.orderBy(F.col("at_ts").desc(), F.col("side").desc()).first()
    assert last.open_incidents == 0
    assert out.agg(F.min("open_incidents")).first()[0] >= 0


def test_no_recovery_is_null(spark):
    log = made(spark, [(1, 1, "2024-01-01 00:00:00", "error"),
                       (2, 2, "2024-01-01 00:00:00", "error"),
                       (3, 2, "2024-01-01 00:00:00", "view"),
                       (4, 2, "2024-01-03 00:00:00", "view")])
    got = {r.user_id: r.recovery_us for r in
           inc.time_to_recovery(log, inc.detect_incidents(log)).collect()}
    assert got == {1: None, 2: 2 * 86_400_000_000}


def test_percentiles_against_builtin(spark):
    for values in ([5], [1, 1, 1, 9], [3, 1_000_000, 2_500_000, 7_000_000, 7_000_001], []):
        ttr = spark.createDataFrame([(v,) for v in values], "recovery_us long")
        got = inc.recovery_percentiles(ttr).first()
        want = ttr.agg(*[F.percentile("recovery_us", F.lit(p)) for p in (0.5, 0.9, 0.99)]).first()
        assert [None if x is None else round(x, 3) for x in got] == \
            [None if x is None else round(x, 3) for x in want]
    assert inc.recovery_percentiles(ttr, approximate=True).count() == 1


# --- order and repeats -------------------------------------------------------------------


def test_tied_times_are_ordered_by_id(spark):
    log = made(spark, [(2, 1, "2024-01-01 00:00:00", "view"),
                       (1, 1, "2024-01-01 00:00:00", "click")])
    got = norm.total_order(log, measure(log)).orderBy("seq").collect()
    assert [(r.event_id, r.seq) for r in got] == [(1, 1), (2, 2)]
    assert rep.replay_final_state(log).first().last_kind == "view"


def test_observed_log_has_the_known_faults(log):
    seen = observed_log(log)
    statuses = dict(val.reconcile_events(log, seen).groupBy("status").count().collect())
    ids = [r.event_id for r in log.select("event_id").collect()]
    missing = [i for i in ids if i % 97 == 13]
    assert statuses["missing"] == len(missing)
    assert statuses["extra"] == sum(i % 211 == 3 for i in ids)
    assert statuses["altered"] == sum(i % 101 == 5 and i % 97 != 13 for i in ids)
    assert norm.duplicate_report(seen).count() == sum(i % 89 == 7 and i % 97 != 13 for i in ids)


def test_disorder_is_found_across_runs(log, monkeypatch):
    late = {r.event_id for r in norm.out_of_order_audit(with_arrival(log)).collect()}
    assert late and all(i % 53 == 11 for i in late)
    monkeypatch.setattr(norm, "SEQUENCE_RUN", 50)
    assert {r.event_id for r in norm.out_of_order_audit(with_arrival(log)).collect()} == late


def test_sequence_gaps_across_runs(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 5), (1, 40), (2, 7)],
                               "conv_id long, turn long")
    want = [(1, 2, 4, 3), (1, 6, 39, 34)]
    for width in (1_000_000, 3):
        monkeypatch.setattr(norm, "SEQUENCE_RUN", width)
        got = norm.sequence_gaps(df, "conv_id", "turn").orderBy("missing_from").collect()
        assert [tuple(r) for r in got] == want


# --- replay and recovery -----------------------------------------------------------------


def test_as_of_the_end_is_the_final_state(log):
    end = rep.replay_as_of(log, "2100-01-01 00:00:00")
    assert failed(val.compare_states(rep.replay_final_state(log), end)) == 0


def test_running_state_ends_in_the_final_state(log, layout):
    last = rep.replay_running_state(log, layout).groupBy("user_id").agg(
        F.max("n").alias("n"), F.max("amount").alias("m"))
    both = last.join(rep.replay_final_state(log), "user_id")
    assert both.where("m > amount").count() == 0
    assert last.select("user_id", "n").exceptAll(
        rep.replay_final_state(log).select("user_id", "n")).count() == 0


def test_repaired_log_reconciles(log):
    fixed = rec.repair_log(log, observed_log(log))
    assert set(r.action for r in fixed.select("action").distinct().collect()) == {
        "kept", "added", "restored"}
    statuses = val.reconcile_events(log, fixed).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in statuses] == [("match", log.count())]


def test_recovery_reaches_the_state_at_the_target(log):
    targets = log.select("user_id").distinct().withColumn(
        "target_ts", F.expr("timestamp_ntz'2024-01-17 13:00:00'"))
    points = rec.recovery_point(rec.snapshots(log), targets)
    got = rec.recover_state(points.where("n is not null"), rec.tail_events(log, points))
    want = rep.replay_as_of(log, "2024-01-17 13:00:00")
    assert failed(val.compare_states(want, got)) == 0


# --- checks report what is broken ---------------------------------------------------------


def test_null_positions_change_the_digest(spark):
    df = spark.createDataFrame([(1, "a", None, "b"), (2, "a", "b", None), (3, "a|b", None, None),
                                (4, "a", "N", "b")], "event_id long, x string, y string, z string")
    assert val.row_digest(df, ["x", "y", "z"]).select("digest").distinct().count() == 4


def test_digests_see_order_and_multiplicity(spark):
    a = made(spark, [(1, 1, "2024-01-01 00:00:00", "view"), (2, 1, "2024-01-01 00:00:01", "click")])
    swapped = made(spark, [(1, 1, "2024-01-01 00:00:01", "view"),
                           (2, 1, "2024-01-01 00:00:00", "click")])
    lay = measure(a)
    cols = ["event_id", "kind"]

    def one(df, name):
        return df.first()[name]

    assert one(val.multiset_digest(a, "user_id", cols), "digest") == \
        one(val.multiset_digest(swapped, "user_id", cols), "digest")
    assert one(val.multiset_digest(a, "user_id", cols), "digest") != \
        one(val.multiset_digest(a.union(a.limit(1)), "user_id", cols), "digest")
    assert one(val.ordered_digest(a, lay, cols), "digest") != \
        one(val.ordered_digest(swapped, lay, cols), "digest")
    assert one(rep.hash_chain(a, lay), "chain") != one(rep.hash_chain(swapped, lay), "chain")


def test_determinism_check(log, layout):
    assert failed(val.determinism_check(log, layout)) == 0
    # A replay that takes its order from the layout of the data must be caught.
    careless = lambda df, _: df.withColumn("p", F.monotonically_increasing_id()).groupBy(
        "user_id").agg(F.max_by("kind", "p").alias("digest"))
    assert failed(val.determinism_check(log, layout, careless)) > 0


def test_idempotence_check(log):
    assert failed(val.idempotence_check(log)) == 0
    assert failed(val.idempotence_check(log, dedupe=lambda df: df)) == log.select(
        "user_id").distinct().count()


def test_snapshot_check(log, monkeypatch):
    assert failed(val.snapshot_check(log, CUT)) == 0
    snaps = rec.snapshots(norm.replay_slice(log, end=CUT))
    assert failed(val.snapshot_check(log, CUT, snaps)) == 0
    broken = snaps.withColumn("n", F.expr("if(user_id = 3, n + 1, n)"))
    assert failed(val.snapshot_check(log, CUT, broken)) == 1
    assert failed(val.snapshot_check(log, CUT, snaps.where("user_id <> 3"))) == 1
    real = rec.snapshots
    monkeypatch.setattr(rec, "snapshots", lambda df: real(df).where("user_id <> 4"))
    assert failed(val.snapshot_check(log, CUT)) == 1


def test_invariants(spark, log):
    from tideline.sources import read_table
    customer = read_table(spark, SF, "customer")
    clean = val.invariant_report(log, customer)
    assert clean.agg(F.sum("violations")).first()[0] == 0
    bad = (log.withColumn("user_id", F.expr("case event_id when 1 then null when 2 then -5 else user_id end"))
           .withColumn("amount", F.expr("cast(if(event_id = 3, -1, amount) as decimal(18,2))"))
           .withColumn("kind", F.expr("if(event_id in (4, 5), 'boom', kind)"))
           .withColumn("k", F.expr("if(event_id = 6, null, k)")))
    got = {r.rule: r.violations for r in val.invariant_report(bad, customer).collect()}
    assert got == {"null_id": 1, "negative_amount": 1, "unknown_kind": 2, "bad_payload": 1,
                   "unknown_entity": 2}


def test_log_diff_counts_copies(log):
    a = log.unionByName(log.where("event_id = 7")).unionByName(log.where("event_id = 7"))
    b = log.where("event_id <> 9").unionByName(log.where("event_id = 7"))
    out = {r.event_id: (r.only_a, r.only_b, r.shared)
           for r in val.log_diff(a, b).where("only_a > 0 or only_b > 0").collect()}
    assert out == {7: (1, 0, 2), 9: (1, 0, 0)}
    assert val.log_diff(log, log).where("only_a > 0 or only_b > 0 or shared <> 1").count() == 0


def test_bucket_diff_finds_one_changed_row(log):
    other = log.withColumn("amount", F.expr("cast(if(event_id = 100, amount + 1, amount) as decimal(18,2))"))
    assert failed(val.bucket_digests(log, other)) == 1
    assert [(r.event_id, r.only_a, r.only_b) for r in val.bucket_digest_diff(log, other)
            .orderBy("only_a").collect()] == [(100, 0, 1), (100, 1, 0)]
    assert val.bucket_digest_diff(log, log).count() == 0


def test_first_divergence_of_each_kind(spark):
    times = [f"2024-01-01 00:00:0{i}" for i in range(5)]
    e = made(spark, [(10 * u + i, u, times[i], "view") for u in range(4) for i in range(4)])
    o = e.where("event_id not in (11)").withColumn(
        "amount", F.expr("cast(if(event_id = 22, 9, amount) as decimal(18,2))"))
    o = o.unionByName(made(spark, [(99, 3, "2024-01-01 00:00:01", "view")]))
    got = {r.user_id: (r.event_id, r.status, r.expected_n, r.observed_n)
           for r in val.first_divergence(e, o).collect()}
    assert got == {1: (11, "missing", 2, 1), 2: (22, "altered", 3, 3), 3: (99, "extra", 2, 3)}
    assert val.first_divergence(e, e).count() == 0


def test_first_divergence_of_moved_events(spark):
    e = made(spark, [(1, 1, "2024-01-01 00:00:00", "view"), (2, 1, "2024-01-01 00:00:05", "view")])
    earlier = made(spark, [(1, 1, "2024-01-01 00:00:00", "view"),
                           (2, 1, "2023-12-31 00:00:00", "view")])
    r = val.first_divergence(e, earlier).first()
    assert (r.event_id, str(r.ts), r.expected_n, r.observed_n) == (2, "2023-12-31 00:00:00", 0, 1)


def test_summary(log):
    out = val.validation_summary({
        "good": val.idempotence_check(log),
        "bad": val.idempotence_check(log, dedupe=lambda df: df)}).collect()
    assert [(r.check, r.failed == 0, r.passed) for r in out] == [("good", True, True),
                                                                 ("bad", False, False)]


# --- sources and sinks --------------------------------------------------------------------


def test_quarantine_keeps_every_line(spark):
    good_line = '{"event_id": 1, "ts": "2024-01-01T00:00:00", "user_id": 2, "event_type": "view", "value": 1.5, "props": "{}"}'
    lines = [good_line, "not json", "", None, good_line.replace('"user_id": 2, ', ""),
             good_line.replace('"event_id": 1, ', ""), good_line[:40], good_line.replace("1.5", '"x"')]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    good, bad = parse_quarantine(df)
    assert [tuple(r)[:3] for r in good.select("event_id", "user_id", "event_type").collect()] == [
        (1, 2, "view")]
    assert good.count() + bad.count() == len(lines)
    assert bad.where("reason is null").count() == 0


def test_timeline_overwrites_only_its_days(spark, log, tmp_path):
    path = str(tmp_path / "timeline")
    full = tl.incident_timeline(log, inc.detect_incidents(log))
    write_timeline(full, path)
    n = spark.read.parquet(path).count()
    write_timeline(full.where("start_ts < timestamp_ntz'2024-01-05'"), path)
    assert spark.read.parquet(path).count() == n == full.count()


def test_slice_reaches_the_scan(spark):
    fresh = norm.canonical_events(read_events(spark, "/root/testdata/sf0.01"))  # not cached
    df = norm.replay_slice(fresh, "2024-01-05 00:00:00", "2024-01-06 00:00:00",
                           ["error"]).select("event_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan


def test_paths_come_in_bounded_parts(log, layout):
    ordered = norm.total_order(log, layout)
    timeline = tl.incident_timeline(ordered, inc.detect_incidents(log, "20 days"))
    whole = {(r.user_id, r.incident_no): r.path for r in tl.incident_path(timeline).collect()}
    parts = tl.incident_path(timeline, part=4).orderBy("user_id", "incident_no", "from_seq").collect()
    joined = {}
    for r in parts:
        assert r.n_events <= 4
        joined.setdefault((r.user_id, r.incident_no), []).append(r.path)
    assert {k: ">".join(v) for k, v in joined.items()} == whole


def test_recovery_reads_only_the_days_after_the_cut(spark, log, tmp_path):
    from tideline.plans.catalog import stored_recovery
    got = stored_recovery(spark, log, str(tmp_path))
    assert rows_of_spark(got) == rows_of_spark(rep.replay_final_state(log))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_events_without_an_id_stay(spark, log):
    some = log.withColumn("event_id", F.expr("if(event_id % 20 = 3, null, event_id)"))
    n = some.where("event_id is null").count()
    assert n and norm.dedupe_events(some).count() == log.count()
    status = {r.status: r["count"] for r in val.reconcile_events(some, some).groupBy("status").count().collect()}
    assert status == {"match": log.count() - n, "unidentified": 2 * n}
    assert rec.repair_log(some, some).count() == log.count()


def test_short_gaps_meet_few_incidents(log):
    one = log.withColumn("user_id", F.lit(1).cast("long"))
    incidents = inc.detect_incidents(one, "1 minute")
    slow, fast = (rows_of_spark(inc.time_to_recovery(one, incidents, g)) for g in ("24 hours", "1 minute"))
    assert slow == fast
    slow, fast = (rows_of_spark(tl.incident_timeline(one, incidents, "10 seconds", "10 seconds", g))
                  for g in ("24 hours", "1 minute"))
    assert slow == fast
