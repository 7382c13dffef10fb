"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.sources.versions import publish, read_published


def write_timeline(df: DataFrame, path: str) -> None:
    """Timeline as Parquet by incident start day. Days not in ``df`` are left as they are.

    Rows are gathered by day with a rebalance, which the adaptive planner splits into files of
    the advisory size: neither one day nor one incident makes one huge task or file.
    """
    (df.withColumn("incident_date", F.to_date("start_ts"))
     .hint("rebalance", F.col("incident_date"))
     .sortWithinPartitions("incident_date", "user_id", "ts", "event_id")
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("incident_date")
     .parquet(path))


def write_dated(df: DataFrame, path: str, time: str = "ts") -> None:
    """A log (or snapshots, by their ``cut_ts``) as Parquet by ``event_date``, the date of
    ``time``. Dates not in ``df`` are left as they are, so a log grows by the days that are new."""
    (df.withColumn("event_date", F.to_date(time))
     .hint("rebalance", F.col("event_date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date").parquet(path))


def read_dated(spark: SparkSession, path: str, schema: T.StructType, time: str = "ts",
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of :func:`write_dated` with ``time`` in ``[start, end)``; only their days are read."""
    full = T.StructType(schema.fields + [T.StructField("event_date", T.DateType())])
    df = spark.read.schema(full).parquet(path)
    if start is not None:
        at = F.expr(f"timestamp_ntz'{start}'")
        df = df.where((F.col("event_date") >= F.to_date(at)) & (F.col(time) >= at))
    if end is not None:
        at = F.expr(f"timestamp_ntz'{end}'")
        df = df.where((F.col("event_date") <= F.to_date(at)) & (F.col(time) < at))
    return df.drop("event_date")


def idempotent_sink(df: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch as a version of its own; a retry replaces it instead of adding to it.

    Readers see the last attempt that was finished, whole, whatever becomes of a later one.
    """
    publish(df, path, f"batch-{batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written by :func:`idempotent_sink` under ``path``."""
    return read_published(spark, path, schema)
