"""Digest trees of stored logs, and replays of tasks that fail."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compare import rows_of_spark
from tideline.operators import (Layout, canonical_events, compare_trees, determinism_check, fail_first_attempts, hash_chain, log_diff,
                                store_tree, tree_diff)
from tideline.operators.failures import may_retry
from tideline.sources import observed_log, read_events, write_dated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return canonical_events(read_events(spark, SF))


def stored(spark, df, path):
    store_tree(df, f"{path}-tree")
    write_dated(df, f"{path}-log")
    schema = T.StructType([*df.schema.fields, T.StructField("event_date", T.DateType())])
    return f"{path}-tree", spark.read.schema(schema).parquet(f"{path}-log")


def test_only_differing_days_are_read(spark, log, tmp_path):
    other = observed_log(log.where("ts < timestamp_ntz'2024-01-04'")).unionByName(log.where("ts >= timestamp_ntz'2024-01-04'"))
    (tree_a, a), (tree_b, b) = stored(spark, log, str(tmp_path / "a")), stored(spark, other, str(tmp_path / "b"))
    counts, leaves = compare_trees(spark, tree_a, tree_b)
    found = {r.level: (r.compared, r.differing) for r in counts.collect()}
    assert found["month"] == (1, 1) and 1 <= found["day"][1] <= 3 and found["hour"][0] <= 3 * 24 and found["leaf"][1] > 0
    diff = tree_diff(leaves, a, b)
    want = log_diff(log, other).where("only_a > 0 or only_b > 0")
    assert rows_of_spark(diff) == rows_of_spark(want)
    # other days are not among the files to read
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan and "2024-01-20" not in plan


def test_equal_empty_and_odd_logs(spark, log, tmp_path):
    odd = log.limit(20).withColumns({
        "ts": F.expr("if(event_id % 2 = 0, null, ts)"), "ts_us": F.expr("if(event_id % 2 = 0, null, ts_us)"),
        "user_id": F.expr("if(event_id % 3 = 0, null, user_id)")})
    (tree_a, a), (tree_b, b) = stored(spark, odd, str(tmp_path / "a")), stored(spark, odd.repartition(3), str(tmp_path / "b"))
    counts, leaves = compare_trees(spark, tree_a, tree_b)
    assert [(r.level, r.differing) for r in counts.orderBy("depth").collect()] == [("month", 0), ("day", 0), ("hour", 0), ("leaf", 0)]
    assert leaves.count() == 0 and tree_diff(leaves, a, b).count() == 0
    changed = odd.withColumn("amount", F.expr("if(event_id = 4, amount + 1, amount)").cast("decimal(18,2)"))
    tree_c, c = stored(spark, changed, str(tmp_path / "c"))
    counts, leaves = compare_trees(spark, tree_a, tree_c)
    assert leaves.count() == 1 and sorted(r.event_id for r in tree_diff(leaves, a, c).collect()) == [4, 4]
    tree_d, _ = stored(spark, odd.where("false"), str(tmp_path / "d"))
    counts, leaves = compare_trees(spark, tree_a, tree_d)
    assert all(r.compared == r.differing > 0 for r in counts.collect())


def test_replay_by_arrival_order_is_reported(spark, log):
    def by_arrival(df, layout):
        return df.withColumn("at", F.monotonically_increasing_id()).groupBy("user_id").agg(
            F.min_by("event_id", "at").cast("string").alias("digest"))
    assert determinism_check(log, Layout("user_id"), by_arrival).where("not ok").count() > 0


RETRIES = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import functions as F
from tideline.operators import Layout, canonical_events, determinism_check, fail_first_attempts, hash_chain
from tideline.operators.failures import may_retry
from tideline.session import build_session
from tideline.sources import read_events
spark = build_session("retries", "local[4,3]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
spark.sparkContext.setLogLevel("OFF")
log = canonical_events(read_events(spark, {sf!r})).repartition(4)
assert may_retry(spark)
def replay(df, layout):
    return hash_chain(df, layout, fan=64).withColumnRenamed("chain", "digest")
ways = {{"as stored": lambda df: df, "failed": fail_first_attempts, "all failed": lambda df: fail_first_attempts(df, 1)}}
out = determinism_check(log, Layout("user_id"), replay, ways).collect()
assert out and all(r.ok and r.runs == 3 for r in out), out[:3]
def attempt(batches):
    import pyarrow as pa
    from pyspark import TaskContext
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().attemptNumber()] * batch.num_rows, pa.int32())], names=["n"])
attempts = {{r.n for r in fail_first_attempts(log, 1).mapInArrow(attempt, "n int").distinct().collect()}}
assert attempts == {{1}}, attempts  # every task has failed once
print("SURVIVED")
"""


def test_failed_attempts_change_nothing(spark, log):
    assert not may_retry(spark) and fail_first_attempts(log) is log
    tests = os.path.dirname(os.path.abspath(__file__))
    code = RETRIES.format(root=os.path.dirname(tests), tests=tests, sf=SF)
    env = os.environ | {"PYTHONPATH": os.path.dirname(tests)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert "SURVIVED" in done.stdout, done.stderr[-2000:]
    assert hash_chain(log, Layout("user_id"), fan=64).count() > 0
