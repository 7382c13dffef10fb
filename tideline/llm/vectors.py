"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are dealt into cells by the signs of a few random projections, several times over with
other projections, so that two vectors that link share one of their cells almost surely. Within a
cell, many more projections are sorted. A vector collides with those whose projection lies in a
window around its own; pairs that collide in enough projections are verified by their cosine. The
number of tables and the least count are computed from the recall wanted at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, comb, erf, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from tideline.llm.batches import others, prepare, quoted, staged
from tideline.llm.components import components
from tideline.session import Scratch

COSINE = 0.9
#: Probability that a pair at the threshold shares a cell, and that it passes the count.
RECALL, COUNT_RECALL = 0.995, 0.9995
#: Sorted projections of a cell, and half the width of a window (of unit vectors' projections).
PROJECTIONS, WINDOW = 64, 0.25
#: Vectors of an average cell, and the most that are sorted together.
CELL, TOGETHER = 400, 1000
_SEED = 20_24


def least_count(cosine: float) -> int:
    """Collisions that a pair at the threshold has with probability ``COUNT_RECALL``."""
    p = erf(WINDOW / (sqrt(2 - 2 * cosine) * sqrt(2)))
    below, c = 0.0, 0
    while True:
        below += comb(PROJECTIONS, c) * p ** c * (1 - p) ** (PROJECTIONS - c)
        if below > 1 - COUNT_RECALL:
            return c
        c += 1


def tables(n: int, cosine: float) -> tuple[int, int]:
    """Signs of a cell and number of tables for ``n`` vectors."""
    signs = max(0, int(np.ceil(np.log2(max(1, n) / CELL))))
    together = (1 - acos(cosine) / pi) ** signs
    return signs, 1 if together >= RECALL else int(np.ceil(np.log(1 - RECALL) / np.log(1 - together)))


@lru_cache(maxsize=16)
def directions(dim: int, n: int, kind: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim, kind]).standard_normal((dim, n))


CELLS = StructType([
    StructField("table", IntegerType()), StructField("dim", IntegerType()), StructField("cell", LongType()),
    StructField("cid", LongType()), StructField("copies", LongType()), StructField("vector", ArrayType(DoubleType()))])
#: Of vector ``a``: ``n`` vectors that link with it, or ``b`` that its links lead to.
FOUND = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("n", LongType())])


@lru_cache(maxsize=16)
def _sides(dim: int, n: int) -> np.ndarray:
    """Directions in whole numbers, so that a sign never depends on the order of a sum."""
    return np.rint(directions(dim, n, 0) * (1 << 10))


def cells(x: np.ndarray, signs: int, tables_: int, n_tables: int) -> np.ndarray:
    """The cell of every vector in each of the first ``tables_`` tables."""
    if not signs:
        return np.zeros((len(x), tables_), np.int64)
    whole = np.rint(x / np.abs(x).max(1, keepdims=True) * (1 << 20))
    side = whole @ _sides(x.shape[1], signs * n_tables)[:, :signs * tables_] > 0
    return side.reshape(len(x), tables_, signs) @ (1 << np.arange(signs, dtype=np.int64))


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    flat = column.flatten().to_numpy()
    return flat[(at[rows] - at[0])[:, None] + np.arange(dim)]


def _deal(signs: int, n_tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector, cid, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("vector", "cid", "copies"))
            dims = np.diff(vector.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                code = cells(_matrix(vector, rows, dim), signs, n_tables, n_tables)
                held = pa.array(rows)
                for t in range(n_tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), t), pa.int32()), pa.array(np.full(len(rows), dim), pa.int32()),
                        pa.array(code[:, t], pa.int64()), cid.take(held), copies.take(held), vector.take(held)],
                        names=CELLS.names)
    return run


def collisions(queries: np.ndarray, others_: np.ndarray) -> np.ndarray:
    """For every pair, in how many projections the other one lies in the query's window."""
    n, m = len(queries), len(others_)
    counts = np.zeros(n * m, np.int16)
    for k in range(queries.shape[1]):
        order = np.argsort(others_[:, k])
        line = others_[order, k]
        low = np.searchsorted(line, queries[:, k] - WINDOW, "left")
        size = np.searchsorted(line, queries[:, k] + WINDOW, "right") - low
        ends = np.cumsum(size)
        at = order[np.arange(ends[-1]) + np.repeat(low - (ends - size), size)]
        counts += np.bincount(np.repeat(np.arange(n) * m, size) + at, minlength=n * m).astype(np.int16)
    return counts.reshape(n, m)


def lead(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` numbers that each is connected to by the pairs ``a``, ``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(cosine: float, signs: int, n_tables: int):
    enough = least_count(cosine)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cid, part, copies = (table.column(c).to_numpy() for c in ("cid", "part", "copies"))
        t, i, j = (table.column(c)[0].as_py() for c in ("table", "i", "j"))
        vector = table.column("vector").combine_chunks()
        x = _matrix(vector, np.arange(len(cid)), table.column("dim")[0].as_py())
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        p = unit @ directions(x.shape[1], PROJECTIONS, 1)
        q, o = (np.flatnonzero(part == i), np.flatnonzero(part == j))
        if not len(q) or not len(o):
            return FOUND_NONE
        a, b = np.nonzero(collisions(p[q], p[o]) >= enough)
        a, b = q[a], o[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        close = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 16):  # a dense cell has many pairs
            s = slice(k, k + (1 << 16))
            close[s] = np.einsum("ij,ij->i", unit[a[s]], unit[b[s]]) >= cosine
        a, b = a[close], b[close]
        if t and len(a):  # a pair counts in the first table that has it in one cell
            rows = np.unique(np.concatenate([a, b]))
            code = cells(x[rows], signs, t, n_tables)
            at, bt = np.searchsorted(rows, a), np.searchsorted(rows, b)
            new = np.ones(len(a), bool)
            for k in range(t):
                new &= code[at, k] != code[bt, k]
            a, b = a[new], b[new]
        n = np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))
        root, linked = lead(a, b, len(cid)), np.flatnonzero(n)
        to = np.where(root[linked] == linked, None, cid[root[linked]].astype(object))
        return pa.table([pa.array(cid[linked]), pa.array(to, pa.int64()), pa.array(n[linked], pa.int64())], names=FOUND.names)
    return run


FOUND_NONE = pa.table([pa.array([], pa.int64())] * 3, names=FOUND.names)


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """What links the ``vectors`` (``cid``, ``copies``, ``vector``) at this cosine, without the pairs.

    A row of ``FOUND`` per vector and cell with new links: ``n``, the copies of the vectors that it
    links with and that no earlier table had in its cell; and ``b``, the vector that leads those
    connected in the cell, null if it leads itself. Cells with more than ``TOGETHER`` vectors are cut
    into parts, and every two parts meet.
    """
    signs, n_tables = tables(vectors.count(), cosine)
    dealt = vectors.mapInArrow(_deal(signs, n_tables), CELLS)
    large = dealt.groupBy("table", "dim", "cell").count().where(F.col("count") > TOGETHER).select(
        "table", "dim", "cell", F.ceil(F.col("count") / TOGETHER).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    placed = dealt.join(large, ["table", "dim", "cell"], "left").withColumn(
        "part", F.pmod(F.xxhash64("cid"), parts).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = placed.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    return met.groupBy("table", "dim", "cell", "i", "j").applyInArrow(_verify(cosine, signs, n_tables), FOUND)


RESULT = [StructField("n_links", LongType()), StructField("component_id", LongType()), StructField("kept", BooleanType())]


def group_near_vectors(
    df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``df`` with the near duplicates of every vector.

    Adds ``n_links``, the other vectors of at least this cosine; ``component_id``, the smallest
    ``vec_id`` that can be reached over such links, its own included; and ``kept``, whether that
    is its own. Cosines are taken in double precision, and vectors of different length link never.

    Vectors that are null, empty, zero, or hold a null or non-finite number link with nothing and
    are their own component. Equal vectors are searched for once and counted; repeated ids count
    as several vectors. A null id never names a component. Older columns of these names are
    replaced. Pairs exactly at the threshold are found with a probability of ``RECALL`` times
    ``COUNT_RECALL``, closer ones more surely, at any number of vectors.
    """
    spark = df.sparkSession
    prepare(spark)
    keep = others(df, [f.name for f in RESULT])
    v = F.col(quoted(vector)).cast("array<double>")
    usable = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0), F.lit(False))
    rows = df.select(
        F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.col(quoted(vec_id)).cast("long").alias("id"),
        F.when(usable, v).alias("vector")).select(
        "row", "id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    with Scratch(spark) as scratch:
        classes = staged(
            rows.where("vector is not null").groupBy("h1", "h2").agg(
                F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
            .withColumn("cid", F.monotonically_increasing_id()), "vectors", scratch)
        found = staged(links(classes.select("cid", "copies", "vector"), cosine), "links", scratch)
        pairs = found.where("b is not null").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        linked = found.groupBy("a").agg(F.sum("n").alias("linked"))
        rooted = classes.join(components(pairs), F.col("cid") == F.col("node"), "left").withColumn(
            "root", F.coalesce("root", "cid"))
        named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        groups = staged(
            rooted.join(named, "root").join(linked, F.col("cid") == F.col("a"), "left").select(
                "h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")),
            "groups")
    some = rows.where("vector is not null").join(groups, ["h1", "h2"])
    none = rows.where("vector is null").select(
        "row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.select("row", "id", "n_links", "component_id").unionByName(none).select(
        *[F.col("row").getField(c).alias(c) for c in keep], "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
