"""Finding incidents and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions import bucket_start, from_micros, micros

INCIDENT = ["user_id", "incident_no"]
DAY = 86_400_000_000


def is_error() -> Column:
    return F.col("kind") == "error"


def detect_incidents(log: DataFrame, gap: str = "24 hours", min_events: int = 1) -> DataFrame:
    """Maximal runs of error events of one user with no gap longer than ``gap``, from 1.

    Errors in one bucket no wider than ``gap`` always share an incident. So errors are first
    reduced to one row per (user, bucket) by a hash aggregate that works map-side, and only
    those rows are ordered: per user at most (time span / gap), however many errors there are.
    Events without a user belong to no incident.
    """
    width = micros(gap)
    cells = (log.where(is_error() & F.col("user_id").isNotNull())
             .groupBy("user_id", bucket_start(F.col("ts_us"), width).alias("_cell"))
             .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
                  F.count("*").alias("n_errors")))
    in_time = Window.partitionBy("user_id").orderBy("_cell")
    starts = F.coalesce(F.col("start_us") - F.lag("end_us").over(in_time) > width, F.lit(True))
    return (cells.withColumn("_starts", starts.cast("long"))
            .withColumn("incident_no", F.sum("_starts").over(
                in_time.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*INCIDENT)
            .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
                 F.sum("n_errors").alias("n_errors"))
            .where(F.col("n_errors") >= min_events)
            .select(*INCIDENT, from_micros(F.col("start_us")).alias("start_ts"),
                    from_micros(F.col("end_us")).alias("end_ts"), "start_us", "end_us",
                    "n_errors"))


def incident_sessions(log: DataFrame, gap: str = "24 hours") -> DataFrame:
    """The same incidents through built-in session windows; a cross-check without numbers.

    ``session_window`` merges an event at exactly ``last + gap``, as ``detect_incidents`` does.
    """
    return (log.where(is_error() & F.col("user_id").isNotNull())
            .groupBy("user_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("n_errors"))
            .select("user_id", F.col("w.start").alias("start_ts"),
                    (F.col("w.end") - F.expr(f"interval {gap}")).alias("end_ts"), "n_errors"))


def time_to_recovery(log: DataFrame, incidents: DataFrame, gap: str = "24 hours") -> DataFrame:
    """First non-error event strictly after the end of each incident; null if there is none.

    Two reductions replace a range join: the first such event inside the bucket of the end
    (equi join on (user, bucket)), and the first one of any later bucket (one row per user and
    bucket, scanned backwards). The earlier of the two is the answer. ``gap`` is that of the
    incidents: ends of one user lie further apart, so a bucket as wide as the gap holds at most
    one, and an event meets at most one end.
    """
    width = micros(gap)
    calm = (log.where(~is_error() & F.col("user_id").isNotNull())
            .select("user_id", "ts_us", bucket_start(F.col("ts_us"), width).alias("_cell")))
    ends = incidents.where("user_id is not null and end_us is not null").select(
        *INCIDENT, "end_us", bucket_start(F.col("end_us"), width).alias("_cell"))

    same = (calm.join(ends, ["user_id", "_cell"]).where("ts_us > end_us")
            .groupBy(*INCIDENT).agg(F.min("ts_us").alias("_at")))

    firsts = calm.groupBy("user_id", "_cell").agg(F.min("ts_us").alias("_first"))
    backwards = (Window.partitionBy("user_id").orderBy(F.col("_cell").desc())
                 .rangeBetween(Window.unboundedPreceding, -1))
    later = (ends.select(*INCIDENT, "_cell", "end_us", F.lit(None).cast("long").alias("_first"))
             .unionByName(firsts.withColumns({"incident_no": F.lit(None).cast("long"),
                                              "end_us": F.lit(None).cast("long")}))
             .withColumn("_at", F.min("_first").over(backwards))
             .where("incident_no is not null")
             .select(*INCIDENT, "end_us", "_at"))

    recovered = F.col("recovered_us")
    return (later.unionByName(same.withColumn("end_us", F.lit(None).cast("long")))
            .groupBy(*INCIDENT)
            .agg(F.max("end_us").alias("end_us"), F.min("_at").alias("recovered_us"))
            .select(*INCIDENT, from_micros(F.col("end_us")).alias("end_ts"),
                    from_micros(recovered).alias("recovered_ts"),
                    (recovered - F.col("end_us")).alias("recovery_us")))


def worst_incidents(incidents: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` incidents per start day by errors; ties by user, then number.

    The rank filter lets Spark keep only ``k`` rows per day in every map task.
    """
    order = Window.partitionBy("start_day").orderBy(F.col("n_errors").desc(), *INCIDENT)
    return (incidents.withColumn("start_day", F.to_date("start_ts"))
            .withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= k)
            .select("start_day", "rank", *INCIDENT, "n_errors"))


def recovery_percentiles(ttr: DataFrame, ps: tuple[float, ...] = (0.5, 0.9, 0.99),
                         cell: str = "1 second", approximate: bool = False) -> DataFrame:
    """Exact percentiles of the recovery time, with linear interpolation.

    The built-in exact percentile holds every distinct value in one task. Here values are
    counted per day and, for the few days holding the wanted ranks, per cell; only the values of
    the cells holding them are ranked.
    ``approximate`` uses the built-in sketch instead.
    """
    names = [f"p{round(p * 100)}_us" for p in ps]
    values = ttr.where("recovery_us is not null").select(F.col("recovery_us").alias("v"))
    if approximate:
        return values.agg(*[F.percentile_approx("v", p).alias(n) for n, p in zip(names, ps)])

    width = micros(cell)
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    days = counts.groupBy(bucket_start(F.col("v"), DAY).alias("c")).agg(F.sum("n").alias("n"))
    # One row per day of recovery time.
    upto = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    days = days.select("c", (F.sum("n").over(upto) - F.col("n")).alias("lo"),
                       F.sum("n").over(upto).alias("hi"),
                       F.sum("n").over(everything).alias("total"))
    # Ranks (from 0) that a percentile interpolates between.
    wanted = days.select("*", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("rank"))
        for i, p in enumerate(ps)])).alias("w")).select(
        "c", "lo", "hi", F.col("w.i").alias("i"), F.col("w.rank").alias("rank"))

    def holding(cells: DataFrame) -> DataFrame:
        return cells.where((F.ceil("rank") >= F.col("lo")) & (F.floor("rank") < F.col("hi")))

    # Of the days that hold a wanted rank, the cells that do.
    inside = counts.withColumn("c", bucket_start(F.col("v"), DAY)).join(
        holding(wanted).select("c", "lo", "i", "rank"), "c")
    inside = inside.groupBy("i", "c", "lo", "rank", bucket_start(F.col("v"), width).alias("s")).agg(
        F.sum("n").alias("n"))
    upto = Window.partitionBy("i", "c").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("lo") + F.sum("n").over(upto)
    wanted = holding(inside.withColumn("hi", hi).select(
        F.col("s").alias("c"), (F.col("hi") - F.col("n")).alias("lo"), "hi", "i", "rank"))
    # At most two cells per percentile, each with at most its width in distinct values.
    inside = counts.withColumn("c", bucket_start(F.col("v"), width)).join(wanted, "c")
    ranked = inside.withColumn("upto", F.col("lo") + F.sum("n").over(
        Window.partitionBy("i", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at_floor = (F.floor("rank") >= F.col("upto") - F.col("n")) & (F.floor("rank") < F.col("upto"))
    at_ceil = (F.ceil("rank") >= F.col("upto") - F.col("n")) & (F.ceil("rank") < F.col("upto"))
    points = ranked.groupBy("i").agg(
        F.max("rank").alias("rank"), F.max(F.when(at_floor, F.col("v"))).alias("a"),
        F.max(F.when(at_ceil, F.col("v"))).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    points = points.select("i", value.alias("value"))
    return points.agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(n)
                        for i, n in enumerate(names)])
