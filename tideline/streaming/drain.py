"""Running a stream over what has arrived so far, into a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tideline.session import fresh_path
from tideline.sources import idempotent_sink, read_batches, store_lines


def drain(out: DataFrame, path: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Process everything available and stop. The file sink writes from the executors and
    commits each batch once; with the same ``path`` a later call resumes where this one ended.
    """
    spark = out.sparkSession
    path = path or fresh_path(spark, "stream")
    done = (out.writeStream.format("parquet").outputMode("append")
            .option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/data"), done


def drain_batches(out: DataFrame, path: str, before_commit=None) -> DataFrame:
    """As :func:`drain`, through ``foreachBatch`` and the idempotent sink. ``before_commit``
    is called after a batch is written and before it is committed; tests let it fail."""
    spark = out.sparkSession

    def write(df: DataFrame, batch_id: int) -> None:
        idempotent_sink(df, batch_id, f"{path}/data")
        if before_commit:
            before_commit(batch_id)

    (out.writeStream.foreachBatch(write).outputMode("append")
     .option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return read_batches(spark, f"{path}/data", out.schema)


def drain_lines(lines: DataFrame, path: str) -> None:
    """Sort the lines of a text stream (column ``line``) into events and quarantine under ``path``;
    a later call resumes where this one ended."""
    (lines.writeStream.foreachBatch(lambda df, batch_id: store_lines(df, batch_id, f"{path}/data"))
     .option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def deliver(events: DataFrame, part: str, root: str, number: int) -> None:
    """Write the events of one delivery where a file stream over ``root`` finds them."""
    (events.where(F.expr(part) == number).write.parquet(f"{root}/delivery-{number}"))


class LateRows(StreamingQueryListener):
    """Counts the rows (after map-side aggregation) that stateful operators dropped as too late.

    Listens to every batch of all queries started inside the ``with`` block, however many there
    are. ``dropped`` is complete once the block is left; leaving it fails if a query has not
    reported its end after ``timeout`` seconds.
    """

    def __init__(self, spark: SparkSession, timeout: float = 60):
        self.spark, self.dropped, self.timeout = spark, 0, timeout
        self._open, self._ended = 0, threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._open += 1

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._open -= 1
            self._ended.notify_all()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind, *_) -> None:
        with self._ended:
            ended = self._ended.wait_for(lambda: self._open == 0, timeout=self.timeout)
        self.spark.streams.removeListener(self)
        if not ended and kind is None:
            raise TimeoutError(f"{self._open} queries have not ended; the count is not complete")
