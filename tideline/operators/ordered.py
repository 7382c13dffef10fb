"""Ordered scans that survive hot keys.

A window over one key puts all its rows in one task. That is fine for most entities and fatal
for one that owns a third of the log. A :class:`Layout` therefore names the keys that are too
large for a task. ``scan`` orders the rows of these keys by ranges of the whole order, sampled
from the rows themselves, and every range is a *run*: neither a burst, nor one instant, nor rows
without a time can make one large. Running values are computed inside every (key, run), reduced
to one row per run with a map-side partial aggregate, carried over those few rows, and added
back. All other keys are plain windows.

A layout never changes results, only how they are computed: any layout is valid for any log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.session import stage

ROWS_PER_RUN = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Hot keys of a log and how many runs their rows are cut into; ``hot`` is None if there
    are none."""

    key: str
    hot: DataFrame | None = None
    runs: int = 0

    @property
    def flat(self) -> bool:
        return self.hot is None


@dataclass(frozen=True)
class FixedRuns:
    """Runs of one width for every key (or for the whole log when there is no key)."""

    at: str
    width: int
    flat: bool = False


@dataclass(frozen=True)
class RangedRuns:
    """So many runs of the whole log, without a key, by ranges sampled from its order. Rows that
    are equal in the order are told apart by a number, so that not even these make a run large."""

    runs: int

    @property
    def flat(self) -> bool:
        return self.runs <= 1


@dataclass(frozen=True)
class Scan:
    """A running value: ``kind`` is sum, max, min or last (last non-null value)."""

    kind: str
    expr: Column
    inclusive: bool = True


def measure(df: DataFrame, key: str = "user_id", rows_per_run: int = ROWS_PER_RUN) -> Layout:
    """Measure a log: rows per key, counted map-side over one column. The driver gets one row, and
    keys are written only if some are hot.

    Ranges are sampled, so runs are planned at half of ``rows_per_run``.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_run)
    rows = per_key.agg(F.sum("n")).first()[0]
    return Layout(key, stage(per_key.select(key), "hot-keys"), -(-2 * rows // rows_per_run)) if rows else Layout(key)


def _of_hot(df: DataFrame, layout: Layout, how: str) -> DataFrame:
    """Rows of hot keys (``left_semi``) or of the others (``left_anti``); a null key may be hot."""
    hot = layout.hot.select(F.col(layout.key).alias("_hot_key"))
    return df.join(hot, F.col(layout.key).eqNullSafe(F.col("_hot_key")), how)


def hot_runs(df: DataFrame, layout: Layout, order: Sequence[str]) -> DataFrame:
    """The rows of hot keys with the number of their run, written so that numbers stay."""
    ranged = _of_hot(df, layout, "left_semi").repartitionByRange(layout.runs, layout.key, *order)
    return stage(ranged.withColumn("_run", F.spark_partition_id().cast("long")), "runs")


def ranged(df: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> RangedRuns:
    """Runs of about half of ``rows_per_run``, as ranges are sampled; one if that is enough."""
    rows = df.count()
    return RangedRuns(1 if rows <= rows_per_run else -(-2 * rows // rows_per_run))


def ranged_runs(df: DataFrame, layout: RangedRuns, order: Sequence[str]) -> DataFrame:
    """The rows with the number of their run, written so that numbers stay."""
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        layout.runs, *order, "_tie")
    return stage(dealt.drop("_tie").withColumn("_run", F.spark_partition_id().cast("long")), "runs")


def _local(s: Scan, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
    if s.kind == "last":
        return F.last(s.expr, ignorenulls=True).over(frame)
    value = {"sum": F.sum, "max": F.max, "min": F.min}[s.kind](s.expr).over(frame)
    return F.coalesce(value, F.lit(0)) if s.kind == "sum" else value


def _total(s: Scan, order: Sequence[str], reverse: bool) -> Column:
    if s.kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(s.expr, F.when(s.expr.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[s.kind](s.expr)


def _merge(s: Scan, local: str, carry: str) -> Column:
    local, carry = F.col(local), F.col(carry)
    if s.kind == "sum":
        return local + F.coalesce(carry, F.lit(0))
    if s.kind == "last":
        return F.coalesce(local, carry)
    return (F.greatest if s.kind == "max" else F.least)(local, carry)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: dict[str, Scan],
         layout: Layout | FixedRuns | RangedRuns, reverse: bool = False) -> DataFrame:
    """Add the running values ``scans`` per ``keys`` in the total order ``order``.

    ``order`` must be unique within a key; nulls come first. With a :class:`Layout` the key is
    the layout's, and ``df`` is read several times if there are hot keys. :class:`RangedRuns` are
    for scans without a key.
    """
    def along(*names):
        return [F.col(n).desc() if reverse else F.col(n).asc() for n in names]

    def flat(rows):
        window = Window.partitionBy(*keys).orderBy(*along(*order))
        return rows.withColumns({name: _local(s, window) for name, s in scans.items()})

    if isinstance(layout, FixedRuns):
        at = F.col(layout.at)
        cut = df.withColumn("_run", F.coalesce(at - F.pmod(at, F.lit(layout.width)),
                                               F.lit(-(1 << 63)).cast("long")))
    elif layout.flat:
        return flat(df)
    elif isinstance(layout, RangedRuns):
        cut = ranged_runs(df, layout, order)
    else:
        cut = hot_runs(df, layout, order)
    types = {f.name: f.dataType for f in df.schema.fields}

    # Joins drop null keys, so a null key is replaced by a value and a flag.
    group = []
    for k in keys:
        zero = F.lit(0).cast(types[k])
        cut = cut.withColumns({f"_k_{k}": F.coalesce(F.col(k), zero),
                               f"_null_{k}": F.col(k).isNull()})
        group += [f"_k_{k}", f"_null_{k}"]
    window = Window.partitionBy(*group, "_run").orderBy(*along(*order))
    local = cut.withColumns({name: _local(s, window) for name, s in scans.items()})
    totals = cut.groupBy(*group, "_run").agg(
        *[_total(s, order, reverse).alias(f"_t_{n}") for n, s in scans.items()])
    # One row per run: few, whatever the number of events.
    before = (Window.partitionBy(*group).orderBy(*along("_run"))
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*group, "_run", *[
        (F.last(F.col(f"_t_{n}"), ignorenulls=True) if s.kind == "last" else
         {"sum": F.sum, "max": F.max, "min": F.min}[s.kind](f"_t_{n}"))
        .over(before).alias(f"_c_{n}") for n, s in scans.items()])
    joined = local.join(carry, [*group, "_run"], "left")
    out = joined.select(*df.columns, *[
        _merge(s, n, f"_c_{n}").cast(local.schema[n].dataType).alias(n) for n, s in scans.items()])
    if not isinstance(layout, Layout):
        return out
    return flat(_of_hot(df, layout, "left_anti")).unionByName(out)


def with_prior(df: DataFrame, key: str, order: Sequence[str], columns: dict[str, str],
               layout: Layout, following: bool = False) -> DataFrame:
    """Add columns of the previous (or next) row of the same key; nulls stay nulls."""
    row = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    out = scan(df, [key], order, {"_row": Scan("last", row, inclusive=False)}, layout,
               reverse=following)
    return out.select(*df.columns, *[F.col(f"_row.{name}").alias(name) for name in columns])
