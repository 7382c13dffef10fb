"""Task attempts that fail on purpose, to see whether a result depends on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def may_retry(spark: SparkSession) -> bool:
    """Whether a failed task is tried again. A plain ``local[n]`` master gives up at once."""
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        tries = re.search(r",\s*(\d+)\]", master)
        return bool(tries) and int(tries[1]) > 1
    return int(spark.conf.get("spark.task.maxFailures", "4")) > 1


def fail_first_attempts(df: DataFrame, every: int = 2) -> DataFrame:
    """``df`` read by tasks of which every ``every``-th fails in its first attempt, after it has
    passed on part of its rows. Where failed tasks are not tried again, ``df`` as it is."""
    if not may_retry(df.sparkSession):
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fails = task.attemptNumber() == 0 and task.partitionId() % every == 0
        for batch in batches:
            yield batch.slice(0, (batch.num_rows + 1) // 2) if fails else batch
            if fails:
                raise RuntimeError("failed on purpose, in the first attempt")

    return df.mapInArrow(run, df.schema)
