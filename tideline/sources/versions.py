"""Tables of versions that appear whole or not at all.

A version of a part (a batch, a snapshot at a cut) is written to a folder of its own, an attempt,
which nobody reads. Creating an empty file, its marker, publishes it: ``<part>~<number>~<attempt>``.
Creating a file is atomic on file systems and object stores alike, and a marker has no content that
could be half written. Readers list the markers, take the highest number of each part, and read
those folders; a marker whose attempt is ``none`` withdraws its part.

An attempt that failed, or one that was superseded, is never read by a reader that starts later.
A reader that has listed the markers goes on with the versions it saw: nothing is overwritten.
``clean`` removes what no marker in force names, when no such reader is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

WITHDRAWN = "none"
# Folders are named as partitions, so that versions with partitions of their own read as one table.
KEYS = ("version_part", "version_attempt")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """The number and attempt in force of every part under ``path``, withdrawn ones included."""
    latest: dict[str, tuple[int, str]] = {}
    for name in _names(spark, f"{path}/markers"):
        part, number, attempt = name.split("~")
        latest[part] = max(latest.get(part, (0, "")), (int(number), attempt))
    return latest


def _mark(spark: SparkSession, path: str, part: str, attempt: str) -> None:
    number = versions(spark, path).get(part, (0, ""))[0] + 1
    fs, at = _files(spark, f"{path}/markers/{part}~{number}~{attempt}")
    fs.create(at, False).close()


def _folder(path: str, part: str, attempt: str) -> str:
    return f"{path}/attempts/{KEYS[0]}={part}/{KEYS[1]}={attempt}"


def publish(df: DataFrame, path: str, part: str, by: Sequence[str] = ()) -> None:
    """Write ``df`` as the version of ``part`` that readers see from now on, in folders by ``by``."""
    if "~" in part or "/" in part:
        raise ValueError("a part's name is part of a file's name")
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(_folder(path, part, attempt))
    _mark(df.sparkSession, path, part, attempt)


def withdraw(spark: SparkSession, path: str, part: str) -> None:
    """Take a part away; publishing it again brings it back."""
    _mark(spark, path, part, WITHDRAWN)


def published(spark: SparkSession, path: str) -> list[str]:
    """The parts that can be read, in the order of their names."""
    return sorted(p for p, (_, attempt) in versions(spark, path).items() if attempt != WITHDRAWN)


def read_published(spark: SparkSession, path: str, schema: T.StructType,
                   parts: Iterable[str] | None = None) -> DataFrame:
    """The versions in force of ``parts``, or of all parts. Only their folders are listed."""
    there = versions(spark, path)
    wanted = there if parts is None else [p for p in parts if p in there]
    folders = [_folder(path, p, there[p][1]) for p in wanted if there[p][1] != WITHDRAWN]
    if not folders:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, *[T.StructField(k, T.StringType()) for k in KEYS]])
    return spark.read.schema(full).option("basePath", f"{path}/attempts").parquet(*folders).drop(*KEYS)


def clean(spark: SparkSession, path: str) -> int:
    """Remove attempts that no version in force names, and markers of older versions. Only while
    nothing is being written or read. Returns how many attempts went."""
    there, gone = versions(spark, path), 0
    for part in _names(spark, f"{path}/attempts"):
        for attempt in _names(spark, f"{path}/attempts/{part}"):
            if there.get(part.split("=")[1], (0, ""))[1] != attempt.split("=")[1]:
                fs, at = _files(spark, f"{path}/attempts/{part}/{attempt}")
                fs.delete(at, True)
                gone += 1
    for name in _names(spark, f"{path}/markers"):
        part, number, attempt = name.split("~")
        if (int(number), attempt) != there[part]:
            fs, at = _files(spark, f"{path}/markers/{name}")
            fs.delete(at, False)
    return gone
