"""Readers. Every source has a declared schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

SCHEMAS = {
    "events": EVENTS,
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]),
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()),
        T.StructField("r_name", T.StringType()),
    ]),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None,
                       glob: str | None = None) -> DataFrame:
    """File stream of the log at ``path``, a file, a folder of part files, or a pattern of them.

    ``ts`` becomes TIMESTAMP, the type watermarks need. A batch takes all files that have
    arrived: the first batch moves the watermark, so rows of files left for later could come too
    late. Set ``max_files`` only for files that arrive in the order of their events.
    """
    # Only a pattern may name a file as well as a folder.
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(EVENTS)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (column ``line``) for :func:`parse_quarantine`."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """JSON event lines (column ``line``) as events; where a line is none, its ``reason`` says why
    and only ``line`` is of use. One row per line, with its other columns."""
    # Times are cast afterwards: the JSON reader's own timestamp parser is slow.
    shape = T.StructType([T.StructField(f.name, T.StringType() if f.name == "ts" else f.dataType)
                          for f in EVENTS.fields] + [T.StructField("_bad", T.StringType())])
    parse = F.from_json("line", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # As a generator of one row, the parse is not copied into every condition below.
    parsed = lines.select("*", F.explode(F.array(parse)).alias("e"))
    ts = F.col("e.ts").try_cast("timestamp_ntz")
    reason = (F.when(F.col("line").isNull(), "empty line")
              .when(F.col("e").isNull() | F.col("e._bad").isNotNull(), "not an event")
              .when(F.col("e.event_id").isNull(), "no event_id")
              .when(F.col("e.user_id").isNull(), "no user_id")
              .when(ts.isNull(), "no ts"))
    return parsed.select(*lines.columns, reason.alias("reason"), *[
        (ts if f.name == "ts" else F.col(f"e.{f.name}")).alias(f.name) for f in EVENTS.fields])


def parse_quarantine(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split JSON event lines (column ``line``) into parsed events and rejects with a reason.

    Parsing is one projection; the two results are filters over it, so no line is lost.
    """
    parsed = parse_lines(lines)
    good = parsed.where("reason is null").select(*EVENTS.names)
    return good, parsed.where("reason is not null").select("line", "reason")
