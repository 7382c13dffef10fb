"""Hot keys: every ordered operator gives the same rows whether keys are cut into runs or not."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import rows_of_spark
from tideline.operators import normalise as norm, replay as rep, timeline as tl, validate as val
from tideline.operators.ordered import Layout, hot_runs, measure
from tideline.sources import read_events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    """A third of the events moved to user 0, many to no user, and many times tied: some to
    the hour, and a whole day of user 0 to one instant."""
    log = norm.canonical_events(read_events(spark, SF))
    log = log.withColumn("user_id", F.expr(
        "case when event_id % 3 = 0 then 0 when event_id % 5 = 1 then null else user_id end"))
    tied = F.expr("""case when user_id = 0 and day(ts) = 9 then 1704800000000000
        when event_id % 2 = 0 then ts_us - ts_us % 3600000000 else ts_us end""")
    return log.withColumn("ts_us", tied).withColumn(
        "ts", F.timestamp_micros("ts_us").cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def layouts(log):
    cut = measure(log, rows_per_run=60)
    hot = [r.user_id for r in cut.hot.collect()]
    assert {0, None} <= set(hot) and len(hot) < 15
    return {"flat": Layout("user_id"), "cut": cut, "tied": measure(log, rows_per_run=10)}


OPERATORS = {
    "total_order": norm.total_order,
    "precursor_event": tl.precursor_event,
    "error_burst": lambda log, lay: tl.error_burst(log, lay, "6 hours", 2),
    "state_spans": tl.state_spans,
    "event_transitions": tl.event_transitions,
    "replay_running_state": rep.replay_running_state,
    "error_streaks": lambda log, lay: rep.error_streaks(log, lay, fan=8),
    "hash_chain": lambda log, lay: rep.hash_chain(log, lay, fan=8),
    "ordered_digest": val.ordered_digest,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_runs_do_not_change_results(name, log, layouts):
    flat = rows_of_spark(OPERATORS[name](log, layouts["flat"]))
    assert flat[1].total() > 0
    assert flat == rows_of_spark(OPERATORS[name](log, layouts["cut"]))
    assert flat == rows_of_spark(OPERATORS[name](log, layouts["tied"]))


def test_result_types_do_not_depend_on_the_layout(log, layouts):
    for op in OPERATORS.values():
        assert op(log, layouts["flat"]).dtypes == op(log, layouts["cut"]).dtypes


ODD = {
    "burst": "timestamp_micros(1704800000000000 + id * 10)",
    "instant": "timestamp_micros(1704800000000000)",
    "no time": "if(id % 3 = 0, null, timestamp_micros(1704800000000000 + id))",
    "before 1970": "if(id % 4 = 0, null, timestamp_micros(-1000000000 + id * 7))",
}


@pytest.mark.parametrize("name", ODD)
def test_runs_hold_what_they_promise(name, spark):
    """A burst, one instant with an outlying id, missing times, and times before 1970."""
    n, most = 4000, 200
    log = spark.range(n).select(
        F.expr("if(id = 7, 1000000000000, id)").alias("event_id"), F.lit(1).cast("long").alias("user_id"),
        F.expr(f"unix_micros({ODD[name]})").alias("ts_us")).repartition(4)
    layout = measure(log, rows_per_run=most)
    runs = hot_runs(log, layout, ["ts_us", "event_id"]).groupBy("_run").count()
    assert runs.agg(F.max("count")).first()[0] <= 2 * most and runs.count() > n / most / 2
    flat = rows_of_spark(norm.total_order(log, Layout("user_id")))
    assert rows_of_spark(norm.total_order(log, layout)) == flat


def by_user(log):
    users = {}
    for r in sorted(log.collect(), key=lambda r: (r.ts_us, r.event_id)):
        users.setdefault(r.user_id, []).append(r)
    return users


def test_total_order_against_python(log, layouts):
    got = {r.event_id: r.seq for r in norm.total_order(log, layouts["cut"]).collect()}
    for rows in by_user(log).values():
        for i, r in enumerate(rows, 1):
            assert got[r.event_id] == i


def test_error_burst_against_python(log, layouts):
    width = 6 * 3_600_000_000
    wanted = Counter()
    for user, rows in by_user(log).items():
        for r in rows:
            n = sum(e.kind == "error" and r.ts_us - width <= e.ts_us <= r.ts_us for e in rows)
            if n >= 2:
                wanted[(r.event_id, n)] += 1
    got = Counter((r.event_id, r.errors_in_width)
                  for r in tl.error_burst(log, layouts["cut"], "6 hours", 2).collect())
    assert got == wanted


def test_error_streaks_against_python(log, layouts):
    got = {r.user_id: (r.n, r.longest) for r in
           rep.error_streaks(log, layouts["cut"], fan=4).collect()}
    for user, rows in by_user(log).items():
        best = run = 0
        for r in rows:
            run = run + 1 if r.kind == "error" else 0
            best = max(best, run)
        assert got[user] == (len(rows), best)


def test_hash_chain_against_python(log, layouts):
    import hashlib

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def chain(items):
        acc = ""
        for i in items:
            acc = sha(f"{acc}|{i}")
        return acc

    got = {r.user_id: r.chain for r in rep.hash_chain(log, layouts["cut"], fan=8).collect()}
    for user, rows in by_user(log).items():
        level = [chain(f"{r.event_id}|{r.kind}" for r in rows[i:i + 8])
                 for i in range(0, len(rows), 8)]
        while len(level) > 1:
            groups = [level[i:i + 8] for i in range(0, len(level), 8)]
            level = [g[0] if len(g) == 1 else chain(g) for g in groups]
        assert got[user] == level[0]


def test_fold_py_merges_stretches(spark, log, layouts):
    from pyspark.sql import types as T

    def fold(pdf):
        return {"path": "".join(k[0] for k in pdf["kind"]), "n": len(pdf)}

    def merge(parts):
        return {"path": "".join(p["path"] for p in parts), "n": sum(p["n"] for p in parts)}

    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("n", T.LongType())])
    out = rep.fold_events_py(log.select("event_id", "user_id", "ts_us", "kind"), layouts["cut"],
                             fold, merge, shape, fan=16)
    got = {r.user_id: (r.path, r.n) for r in out.collect()}
    for user, rows in by_user(log).items():
        assert got[user] == ("".join(r.kind[0] for r in rows), len(rows))


def test_folds_do_not_depend_on_the_age_of_the_layout(log):
    old = measure(log.where("event_id % 10 = 0"), rows_per_run=20)
    want = rows_of_spark(rep.hash_chain(log, Layout("user_id"), fan=4))
    assert rows_of_spark(rep.hash_chain(log, old, fan=4)) == want


def test_disorder_with_one_arrival_for_a_third_and_none_for_some(spark):
    import random

    from tideline.operators import out_of_order_audit
    from tideline.operators.ordered import RangedRuns, ranged, ranged_runs

    rng = random.Random(4)
    rows = [(k if k % 7 else None, rng.randint(0, 10 ** 6), rng.choice([None, 5, 5, rng.randint(0, 99)])) for k in range(900)]
    rows += [(1, 77, 5)] * 400  # equal rows, too
    df = spark.createDataFrame(rows, "event_id long, ts_us long, arrival long").selectExpr(
        "*", "1L as user_id", "cast(timestamp_micros(ts_us) as timestamp_ntz) as ts").repartition(5)
    order = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in (r[2], r[0], r[1])))
    want, top = [], None
    for event_id, ts_us, arrival in order:
        if top is not None and ts_us < top:
            want.append((event_id or -1, arrival or -1, top - ts_us, top - ts_us > 500_000))
        top = ts_us if top is None else max(top, ts_us)
    for size in (100_000, 100):
        got = out_of_order_audit(df, lateness=500_000, rows_per_run=size)
        assert sorted((r.event_id or -1, r.arrival or -1, r.late_us, r.beyond_lateness) for r in got.collect()) == sorted(want)
    layout = ranged(df, 100)
    assert layout == RangedRuns(26) and ranged(df, 10_000).flat
    sizes = [r["count"] for r in ranged_runs(df, layout, ["arrival", "event_id", "ts_us"]).groupBy("_run").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 200
