"""Stored digests of a log as a tree, so that two copies are compared from the top.

The leaves are one digest per hour and share of the users; hours, days and months are sums of what
is below them. Only what differs is looked into: two equal logs are told by their months, and rows
are read of the days in which a leaf differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.functions import bucket_start, sum_fingerprints
from tideline.operators.validate import CONTENT, log_diff
from tideline.session import stage

SHARES = 16
HOUR = 3_600_000_000
NO_TIME = -(1 << 63)
# The key of each level, which holds that of the one above.
LEVELS = {"month": ["month"], "day": ["month", "day"], "hour": ["month", "day", "hour"],
          "leaf": ["month", "day", "hour", "share"]}
_KINDS = {"month": T.DateType(), "day": T.DateType(), "hour": T.LongType(), "share": T.IntegerType()}
# Days up to this many are named in the filter of the scan; of more, the first and the last are.
NAMED_DAYS = 1000


def _placed(log: DataFrame, shares: int) -> DataFrame:
    """With the key of each row's leaf. Rows without a time have an hour of their own."""
    return log.withColumns({
        "month": F.trunc("ts", "month"), "day": F.to_date("ts"),
        "hour": F.coalesce(bucket_start(F.col("ts_us"), HOUR), F.lit(NO_TIME).cast("long")),
        "share": F.pmod(F.coalesce("user_id", F.lit(-1).cast("long")), F.lit(shares)).cast("int")})


def store_tree(log: DataFrame, path: str, cols: Sequence[str] = ("event_id", *CONTENT),
               shares: int = SHARES) -> None:
    """Write the digests of all levels under ``path``, leaves by day. The log is read once."""
    spark, key = log.sparkSession, LEVELS["leaf"]
    cells = _placed(log, shares).withColumn("_cell", F.struct(*key))
    leaves = sum_fingerprints(cells, "_cell", cols).select("_cell.*", "n", "digest")
    leaves.withColumn("event_date", F.col("day")).write.partitionBy("event_date").parquet(f"{path}/leaf")
    below = _level(spark, path, "leaf")
    for level in ("hour", "day", "month"):
        sums = below.groupBy(*LEVELS[level]).agg(
            F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
        sums.write.parquet(f"{path}/{level}")
        below = spark.read.schema(sums.schema).parquet(f"{path}/{level}")


def _level(spark: SparkSession, path: str, level: str) -> DataFrame:
    fields = [T.StructField(k, _KINDS[k]) for k in LEVELS[level]]
    fields += [T.StructField("n", T.LongType()), T.StructField("digest", T.DecimalType(38, 0))]
    if level == "leaf":
        fields.append(T.StructField("event_date", T.DateType()))
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{level}")


def _same(a: str, b: str, names: Sequence[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def compare_trees(spark: SparkSession, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Stored trees ``a`` and ``b`` from the top: per level, how many keys were compared and how
    many differ; and the keys of the leaves that differ. A level is compared below what differs."""
    counts, above, up = [], None, []
    for number, (level, key) in enumerate(LEVELS.items()):
        def side(path):
            rows = _level(spark, path, level)
            if above is None:
                return rows
            if level == "leaf":  # folders of other days are not listed among the files to read
                days = [r[0] for r in above.select("day").distinct().limit(NAMED_DAYS + 1).collect()]
                some = [d for d in days if d is not None]
                if len(days) <= NAMED_DAYS:
                    rows = rows.where(F.col("event_date").isin(some) | F.lit(None in days) & F.col("event_date").isNull())
            return rows.alias("x").join(above.alias("y"), _same("x", "y", up), "left_semi")
        both = side(a).alias("a").join(side(b).alias("b"), _same("a", "b", key), "full")
        same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        here = F.col("a.n").isNotNull()
        met = stage(both.select(
            *[F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key], same.alias("ok")), "level")
        counts.append(met.agg(F.count("*").alias("compared"), F.count_if(~F.col("ok")).alias("differing")).select(
            F.lit(number).alias("depth"), F.lit(level).alias("level"), "compared", "differing"))
        above, up = met.where("not ok").drop("ok"), key
    return reduce(DataFrame.unionByName, counts), above


def tree_diff(leaves: DataFrame, a: DataFrame, b: DataFrame, shares: int = SHARES,
              cols: Sequence[str] = ("event_id", *CONTENT)) -> DataFrame:
    """Rows that differ between the dated logs ``a`` and ``b`` (with their ``event_date``), looked for
    in ``leaves`` only. Days without one are not read."""
    days = [r[0] for r in leaves.select("day").distinct().limit(NAMED_DAYS + 1).collect()]
    some = sorted(d for d in days if d is not None)
    named = F.col("event_date").isin(some) | F.lit(None in days) & F.col("event_date").isNull()
    if len(days) > NAMED_DAYS:
        first, last = leaves.agg(F.min("day"), F.max("day")).first()
        named = F.col("event_date").between(first, last) | F.col("event_date").isNull()

    def there(log):
        rows = _placed(log.where(named), shares).alias("x")
        return rows.join(leaves.alias("y"), _same("x", "y", LEVELS["leaf"]), "left_semi")

    return log_diff(there(a), there(b), cols).where("only_a > 0 or only_b > 0")
