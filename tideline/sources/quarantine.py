"""Lines of a stream, as events or in quarantine.

Every batch is parsed once and published as one version: its events and its rejected lines appear
together, or not yet. Rejected lines that can be mended are read again later, and their batch is
published anew, so at any time every line is either an event or in quarantine, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tideline.sources.logs import EVENTS, parse_lines
from tideline.sources.versions import publish, published, read_published

STORED = T.StructType([
    T.StructField("line", T.StringType()), T.StructField("reason", T.StringType()), *EVENTS.fields,
    T.StructField("good", T.BooleanType())])


def _sorted_out(lines: DataFrame) -> DataFrame:
    """Parsed lines; events do not keep their text."""
    parsed = parse_lines(lines).withColumn("good", F.col("reason").isNull())
    return parsed.withColumn("line", F.when(~F.col("good"), F.col("line"))).select(*STORED.names)


def store_lines(lines: DataFrame, batch_id: int, path: str) -> None:
    """Parse the ``line``s of a batch and publish them under ``path``; a retry replaces them."""
    publish(_sorted_out(lines), path, f"batch-{batch_id}", ["good"])


def admitted(spark: SparkSession, path: str) -> DataFrame:
    """The events of all batches."""
    return read_published(spark, path, STORED).where("good").select(*EVENTS.names)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all batches that are no events, and why."""
    return read_published(spark, path, STORED).where("not good").select("line", "reason")


def readmit(spark: SparkSession, path: str, mend: Callable[[Column], Column]) -> None:
    """Read the lines in quarantine again, as ``mend`` changes them.

    Those that are events now move over; the others stay as they came. Each batch is one version,
    so a run that is cut short has done some batches and left the rest, and may be repeated.
    """
    for part in published(spark, path):
        stored = read_published(spark, path, STORED, [part])
        lost = stored.where("not good").select(F.col("line").alias("came"), F.col("reason").alias("why"))
        again = parse_lines(lost.withColumn("line", mend(F.col("came"))))
        if again.where("reason is null").isEmpty():
            continue
        still = again.where("reason is not null").select(
            F.col("came").alias("line"), F.col("why").alias("reason"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields], F.lit(False).alias("good"))
        moved = again.where("reason is null").select(
            F.lit(None).cast("string").alias("line"), "reason", *EVENTS.names, F.lit(True).alias("good"))
        publish(stored.where("good").unionByName(moved).unionByName(still), path, part, ["good"])
