"""Incidents against each other: order over the whole log rather than per user.

Boundaries are first aggregated by exact time. A run of one minute then holds at most
60 million rows, whatever share of the incidents falls into it, and the carry over the runs
has one row per minute of the log. Both bounds follow from the clock, not from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import from_micros
from tideline.operators.incidents import INCIDENT
from tideline.operators.ordered import FixedRuns, Scan, scan
from tideline.session import stage

MINUTE = 60_000_000
OPENS, CLOSES = 0, 1


def _boundaries(incidents: DataFrame) -> DataFrame:
    """Openings and closings per exact time; an opening sorts before a closing."""
    both = incidents.select(F.explode(F.array(
        F.struct(F.col("start_us").alias("at_us"), F.lit(OPENS).alias("side")),
        F.struct(F.col("end_us").alias("at_us"), F.lit(CLOSES).alias("side")))).alias("b"))
    return both.groupBy("b.at_us", "b.side").agg(F.count("*").alias("changes"))


def concurrent_incidents(incidents: DataFrame) -> DataFrame:
    """Number of open incidents after each boundary; openings count before closings."""
    step = F.when(F.col("side") == OPENS, F.col("changes")).otherwise(-F.col("changes"))
    return scan(_boundaries(incidents), [], ["at_us", "side"],
                {"open_incidents": Scan("sum", step)}, FixedRuns("at_us", MINUTE)).select(
        from_micros(F.col("at_us")).alias("at_ts"), F.col("side").cast("long").alias("side"),
        "changes", "open_incidents")


def merge_overlapping(incidents: DataFrame, min_events: int = 3) -> DataFrame:
    """Merge incidents of any users that overlap or touch into numbered outages.

    An outage starts where no earlier incident is still open, that is where the running count
    of open incidents leaves zero; numbering and grouping need one more pass over those points.
    """
    chosen = incidents.where(F.col("n_errors") >= min_events)
    steps = chosen.select(F.explode(F.array(
        F.struct(F.col("start_us").alias("at_us"), F.lit(OPENS).alias("side"),
                 F.col("n_errors").alias("n_errors")),
        F.struct(F.col("end_us").alias("at_us"), F.lit(CLOSES).alias("side"),
                 F.lit(0).cast("long").alias("n_errors")))).alias("b"))
    steps = steps.groupBy("b.at_us", "b.side").agg(
        F.count("*").alias("changes"), F.sum("b.n_errors").alias("n_errors"))
    opens = F.when(F.col("side") == OPENS, F.col("changes"))
    walk = scan(steps, [], ["at_us", "side"], {
        "_open": Scan("sum", F.coalesce(opens, -F.col("changes"))),
        "_incidents": Scan("sum", F.coalesce(opens, F.lit(0))),
        "_errors": Scan("sum", F.col("n_errors"))}, FixedRuns("at_us", MINUTE))
    # Every outage ends exactly where the count returns to zero; the totals there are running
    # totals, so an outage is the difference between two consecutive ends.
    edge = stage(walk.where((F.col("_open") == 0) | (
        (F.col("side") == OPENS) & (F.col("_open") == F.col("changes")))), "outage-edges")
    numbered = scan(edge, [], ["at_us", "side"], {
        "outage_no": Scan("sum", (F.col("side") == OPENS).cast("long"))},
        FixedRuns("at_us", MINUTE))
    outage = numbered.groupBy("outage_no").agg(
        F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"),
        F.max(F.when(F.col("side") == CLOSES, F.col("_incidents"))).alias("_incidents"),
        F.max(F.when(F.col("side") == CLOSES, F.col("_errors"))).alias("_errors"))
    totals = scan(outage, [], ["start_us", "outage_no"], {
        "_incidents_before": Scan("max", F.col("_incidents"), inclusive=False),
        "_errors_before": Scan("max", F.col("_errors"), inclusive=False)},
        FixedRuns("start_us", MINUTE))
    return totals.select(
        "outage_no", from_micros(F.col("start_us")).alias("start_ts"),
        from_micros(F.col("end_us")).alias("end_ts"),
        (F.col("_incidents") - F.coalesce("_incidents_before", F.lit(0))).alias("n_incidents"),
        (F.col("_errors") - F.coalesce("_errors_before", F.lit(0))).alias("n_errors"))


def overlapping_incidents(incidents: DataFrame) -> DataFrame:
    """For each incident, how many other incidents were open at some moment of it.

    Counted, not listed: a list of pairs is quadratic when many incidents fall together.
    Others overlap unless they end before this one starts or start after it ends, so the count
    is (openings up to my end) - (closings before my start) - 1, and both are running sums.
    Incidents of one user never overlap, so all others belong to other users.
    """
    ends = _boundaries(incidents)
    walk = scan(ends, [], ["at_us", "side"], {
        "_opened": Scan("sum", F.when(F.col("side") == OPENS, F.col("changes")).otherwise(0)),
        "_closed": Scan("sum", F.when(F.col("side") == CLOSES, F.col("changes")).otherwise(0)),
    }, FixedRuns("at_us", MINUTE))
    # A closing row already counts every opening at its time; an opening row no closing at it.
    opened = walk.where(F.col("side") == CLOSES).select(F.col("at_us").alias("end_us"), "_opened")
    closed = walk.where(F.col("side") == OPENS).select(F.col("at_us").alias("start_us"), "_closed")
    return (incidents.join(opened, "end_us").join(closed, "start_us")
            .select(*INCIDENT, "start_ts", "end_ts",
                    (F.col("_opened") - F.col("_closed") - 1).alias("n_overlapping")))
