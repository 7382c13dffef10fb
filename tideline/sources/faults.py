"""A faulty copy of the canonical log, derived from the given events by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The fault rules of FIXTURES.md.
MISSING = "event_id % 97 = 13"
ALTERED = "event_id % 101 = 5"
REPEATED = "event_id % 89 = 7"
EXTRA = "event_id % 211 = 3"
EXTRA_ID_OFFSET = 1_000_000_000
DISORDERED = "event_id % 53 = 11"
DISORDER_SHIFT = 500


def observed_log(log: DataFrame) -> DataFrame:
    """A second copy of ``log`` with missing, altered, repeated and extra events."""
    kept = log.where(f"not ({MISSING})").withColumn(
        "amount", F.expr(f"cast(amount + if({ALTERED}, 1, 0) as decimal(18,2))"))
    kept = kept.withColumn("_copy", F.explode(
        F.expr(f"if({REPEATED}, array(1, 2), array(1))"))).drop("_copy")
    extra = log.where(EXTRA).withColumns({
        "event_id": F.col("event_id") + EXTRA_ID_OFFSET,
        "ts": F.col("ts") + F.expr("interval 1 second"),
        "ts_us": F.col("ts_us") + 1_000_000})
    return kept.unionByName(extra)


def with_arrival(log: DataFrame) -> DataFrame:
    """Arrival numbers of a disordered delivery; ties are broken by ``event_id``."""
    return log.withColumn("arrival", F.expr(
        f"event_id + if({DISORDERED}, {DISORDER_SHIFT}, 0)"))
