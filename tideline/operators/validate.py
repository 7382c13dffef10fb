"""Checks that a replay is deterministic and that two logs, or two states, agree.

Checks return one row per key with a boolean ``ok``; ``validation_summary`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions import bucket_start, from_micros, micros, row_hash, sum_fingerprints
from tideline.operators.normalise import KINDS, dedupe_events, total_order
from tideline.operators.ordered import Layout
from tideline.operators.replay import STATE, hash_chain, replay_final_state
from tideline.session import stage

CONTENT = ["user_id", "ts_us", "kind", "amount"]
# A list of differing buckets up to this long is broadcast; a longer one is joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def row_digest(df: DataFrame, cols: Sequence[str], key: str = "event_id") -> DataFrame:
    """SHA-256 of the canonical text of each row."""
    return df.select(key, row_hash(df, cols).alias("digest"))


def multiset_digest(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Digest per key that ignores order but not multiplicity. A sum, so aggregated map-side."""
    return sum_fingerprints(df, key, cols)


def ordered_digest(df: DataFrame, layout: Layout,
                   cols: Sequence[str] = ("event_id", *CONTENT)) -> DataFrame:
    """Digest per user that depends on the order of its events.

    Every event is fingerprinted together with its replay number, and the fingerprints are
    summed: order is covered, yet nothing has to be collected per user.
    """
    needed = dict.fromkeys(["event_id", "user_id", "ts_us", *cols])
    slim = total_order(df.select(*needed), layout)
    return sum_fingerprints(slim, "user_id", ["seq", *cols])


def paired_events(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Both logs side by side per event: structs ``e`` and ``o`` and a ``status``.

    Repeats are dropped first, which shuffles by event id; the full outer join reuses that, and
    each log is read once. Events without an id cannot be paired: each is a row of its own, ``unidentified``.
    """
    def side(df, name, odd):
        # a number for each nameless event, even on one side and odd on the other: none is paired
        number = F.when(F.col("event_id").isNull(), 2 * F.monotonically_increasing_id() + odd)
        rows = df.select(F.coalesce("event_id", F.lit(0)).alias("id"), F.coalesce(number, F.lit(-1)).alias("nameless"),
                         "event_id", *CONTENT)
        first = (rows.withColumn("_rank", F.row_number().over(Window.partitionBy("id", "nameless").orderBy(*CONTENT)))
                 .where("_rank = 1"))
        return first.select("id", "nameless", F.struct(*CONTENT).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}"))
                                       for c in CONTENT])
    nameless = F.col("nameless") >= 0
    status = (F.when(nameless, "unidentified").when(F.col("o").isNull(), "missing")
              .when(F.col("e").isNull(), "extra").when(same, "match").otherwise("altered"))
    both = side(expected, "e", 0).join(side(observed, "o", 1), ["id", "nameless"], "full")
    return both.select(F.when(~nameless, F.col("id")).alias("event_id"), "e", "o", status.alias("status"))


def reconcile_events(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """match / missing / extra / altered / unidentified per event."""
    return paired_events(expected, observed).select(
        "event_id", F.coalesce("e.user_id", "o.user_id").alias("user_id"), "status",
        F.col("e.amount").alias("expected_amount"), F.col("o.amount").alias("observed_amount"))


def first_divergence(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """First event per user at which the replayed states differ, and both states there.

    Two replays agree exactly as long as their logs do, so the first differing state is at the
    first differing event: a minimum per user over the differences, with no ordered replay of
    either log. The states at that point are sums over the events up to it.
    """
    pairs = stage(paired_events(expected, observed).where("event_id is not null"), "pairs")
    sides = F.array(F.struct("e.user_id", "e.ts_us"), F.struct("o.user_id", "o.ts_us"))
    places = pairs.where("status <> 'match'").select("event_id", "status", F.explode(
        F.array_distinct(F.filter(sides, lambda s: s["user_id"].isNotNull()))).alias("at"))
    first = (
        places.groupBy("at.user_id")
        .agg(F.min(F.struct("at.ts_us", "event_id", "status")).alias("_f"))
        .select("user_id", F.col("_f.ts_us").alias("_ts"), F.col("_f.event_id").alias("_id"),
                F.col("_f.status").alias("status")))

    # Both states at once: every event of either log, up to its user's first difference.
    def rows(side):
        return F.struct(F.col(f"{side}.user_id").alias("user_id"), F.col(f"{side}.ts_us").alias("ts_us"),
                        F.lit(side).alias("side"), F.col(f"{side}.amount").alias("amount"))
    upto = F.struct("at.ts_us", "event_id") <= F.struct("_ts", "_id")
    events = pairs.select("event_id", F.explode(F.array(rows("e"), rows("o"))).alias("at")).where(
        "at.user_id is not null").select("event_id", "at", F.col("at.user_id").alias("user_id"))
    states = (events.join(first, "user_id").where(upto).groupBy("user_id").agg(
        *[x for side, name in (("e", "expected"), ("o", "observed")) for x in (
            F.count_if(F.col("at.side") == side).alias(f"{name}_n"),
            F.sum(F.when(F.col("at.side") == side, F.col("at.amount"))).alias(f"{name}_amount"))]))
    return first.join(states, "user_id", "left").select(
        "user_id", F.col("_id").alias("event_id"), from_micros(F.col("_ts")).alias("ts"), "status",
        F.coalesce("expected_n", F.lit(0)).alias("expected_n"), "expected_amount",
        F.coalesce("observed_n", F.lit(0)).alias("observed_n"), "observed_amount")


Rearrange = Callable[[DataFrame], DataFrame]
ARRANGEMENTS: dict[str, Rearrange] = {
    "as stored": lambda df: df,
    "spread by event": lambda df: df.repartition(F.col("event_id")),
    "shuffled order": lambda df: df.repartitionByRange(F.xxhash64("event_id")),
}


def determinism_check(log: DataFrame, layouts: Layout | Sequence[Layout],
                      replay: Callable[[DataFrame, Layout], DataFrame] | None = None,
                      arrangements: dict[str, Rearrange] = ARRANGEMENTS) -> DataFrame:
    """Replay the log under several partitionings, input orders and layouts; one digest per user.

    ``replay`` returns ``user_id`` and ``digest``; by default it is the hash chain. Arrangements
    take the layouts in turn, every layout at least once. The log is written once and all
    arrangements read that.
    """
    layouts = [layouts] if isinstance(layouts, Layout) else list(layouts)
    replay = replay or (
        lambda df, layout: hash_chain(df, layout).withColumnRenamed("chain", "digest"))
    log, ways = stage(log, "replayed"), list(arrangements.values())
    n = max(len(ways), len(layouts))
    runs = reduce(DataFrame.unionByName, [
        replay(ways[k % len(ways)](log), layouts[k % len(layouts)]).select(
            "user_id", F.col("digest").cast("string").alias("digest")) for k in range(n)])
    return runs.groupBy("user_id").agg(
        F.min("digest").alias("digest"), F.count("*").alias("runs"),
        ((F.min("digest") == F.max("digest")) & (F.count("*") == n)).alias("ok"))


def compare_states(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two sets of states, null-safe: the expected state and ``ok`` per user."""
    e = expected.select("user_id", F.struct(*STATE).alias("e"))
    a = actual.select("user_id", F.struct(*STATE).alias("a"))
    joined = e.join(a, "user_id", "full")
    same = reduce(lambda x, y: x & y, [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
                                       for c in STATE])
    return joined.select("user_id", "e.*", (F.col("e").isNotNull() & F.col("a").isNotNull()
                                            & same).alias("ok"))


def idempotence_check(log: DataFrame, dedupe: Rearrange = dedupe_events) -> DataFrame:
    """Replay of the log delivered twice, after dropping repeats, against replay of the log."""
    return compare_states(replay_final_state(log),
                          replay_final_state(dedupe(log.unionByName(log))))


def snapshot_check(log: DataFrame, cut: str, snaps: DataFrame | None = None) -> DataFrame:
    """State recovered from the snapshots at ``cut`` and the tail against full replay, per user.

    ``cut`` is the end of a snapshot period. ``snaps`` are stored snapshots, made anew if absent.
    """
    from tideline.operators import recovery

    at = F.expr(f"timestamp_ntz'{cut}'")
    if snaps is None:
        snaps = recovery.snapshots(log.where(F.col("ts") < at))
    recovered = recovery.recover_state(recovery.snapshot_at(snaps, cut), log.where(F.col("ts") >= at))
    return compare_states(replay_final_state(log), recovered)


# Conditions that hold for a broken event, on the canonical log.
RULES = {
    "null_id": "event_id is null or user_id is null or ts is null",
    "negative_amount": "amount < 0",
    "unknown_kind": "kind is null or kind not in ({})".format(", ".join(f"'{k}'" for k in KINDS)),
    "bad_payload": "k is null",
}


def invariant_report(log: DataFrame, customer: DataFrame | None = None,
                     rules: dict[str, str] = RULES) -> DataFrame:
    """Violations per rule. All row rules share one aggregate; the entity rule joins distinct
    entities with their counts, not events."""
    counts = log.agg(F.count("*").alias("checked"), *[
        F.count_if(F.expr(condition)).alias(name) for name, condition in rules.items()])
    rows = counts.select("checked", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
        .alias("r")).select("r.rule", "checked", "r.violations")
    if customer is None:
        return rows
    users = log.groupBy("user_id").agg(F.count("*").alias("n"))
    known = customer.select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    entity = users.join(known, "user_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
        .alias("violations"))
    return rows.unionByName(entity.select(F.lit("unknown_entity").alias("rule"), "checked",
                                          "violations"))


def log_diff(a: DataFrame, b: DataFrame,
             cols: Sequence[str] = ("event_id", *CONTENT)) -> DataFrame:
    """Distinct rows of two logs with the number of copies only in a, only in b, and shared.

    One aggregate answers both differences and the intersection with multiplicity, and copies
    are counted map-side instead of being written out one by one.
    """
    both = (a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    zero = F.lit(0).cast("long")
    return both.groupBy(*cols).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb")).select(
        *cols, F.greatest(F.col("_na") - F.col("_nb"), zero).alias("only_a"),
        F.greatest(F.col("_nb") - F.col("_na"), zero).alias("only_b"),
        F.least("_na", "_nb").alias("shared"))


def bucket_digests(a: DataFrame, b: DataFrame, bucket: str = "1 day",
                   cols: Sequence[str] = ("event_id", *CONTENT)) -> DataFrame:
    """One digest per bucket of either log and whether they agree."""
    width = micros(bucket)

    def side(df, name):
        cells = df.withColumn("_cell", bucket_start(F.col("ts_us"), width))
        return multiset_digest(cells, "_cell", cols).select(
            "_cell", F.col("n").alias(f"n_{name}"), F.col("digest").alias(f"digest_{name}"))

    joined = side(a, "a").join(side(b, "b"), "_cell", "full")
    same = (F.col("n_a").eqNullSafe(F.col("n_b"))
            & F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return joined.select("_cell", from_micros(F.col("_cell")).alias("bucket_ts"),
                         "n_a", "n_b", "digest_a", "digest_b", same.alias("ok"))


def bucket_digest_diff(a: DataFrame, b: DataFrame, bucket: str = "1 day",
                       cols: Sequence[str] = ("event_id", *CONTENT)) -> DataFrame:
    """Differing rows, compared only in the buckets whose digests differ."""
    width = micros(bucket)
    cells = stage(bucket_digests(a, b, bucket, cols).where("not ok").select("_cell"), "buckets")
    if cells.count() <= BROADCAST_BUCKETS:
        cells = F.broadcast(cells)

    def there(df):
        return (df.withColumn("_cell", bucket_start(F.col("ts_us"), width))
                .join(cells, "_cell", "left_semi"))

    return log_diff(there(a), there(b), cols).where("only_a > 0 or only_b > 0")


def validation_summary(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: keys checked, keys failed, passed."""
    def line(name, df):
        return df.agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed")
                      ).select(F.lit(name).alias("check"), "checked", "failed",
                               (F.col("failed") == 0).alias("passed"))
    return reduce(DataFrame.unionByName, [line(n, df) for n, df in checks.items()])
