"""Exact top-k search by inner product, with tiles of queries and shards.

Vectors of whole numbers are packed into shards, the queries among them into blocks. A tile is
the matrix product of a block and a shard; only the best of every query leave it, and a task keeps
one running list per query over all its shards. The lists of the tasks are merged in a tree, a
fixed number at a time. Blocks go to the shards in passes of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tideline.llm.batches import others, prepare, quoted, staged
from tideline.session import Scratch

K = 20
#: Vectors of a shard, queries of a block, and shards of a task.
SHARD, BLOCK, TASK = 4096, 512, 16
#: Bytes of the blocks that meet all shards in one pass.
PASS_BYTES = 32 << 20
#: Lists of one block that are merged together.
FAN = 16
_EXACT = 1 << 53

PACKED = StructType([
    StructField("dim", IntegerType()), StructField("at", LongType()), StructField("bytes", LongType()),
    StructField("ids", BinaryType()), StructField("rows", BinaryType()), StructField("data", BinaryType()),
    StructField("asked", BinaryType())])
LISTS = StructType([
    StructField("block", LongType()), StructField("part", LongType()), StructField("n", IntegerType()),
    StructField("ids", BinaryType()), StructField("rows", BinaryType()),
    StructField("scores", BinaryType()), StructField("found", BinaryType())])
FOUND = StructType([
    StructField("query_id", LongType()), StructField("rank", IntegerType()),
    StructField("vec_id", LongType()), StructField("score", LongType())])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _batch(schema: StructType, *values) -> pa.RecordBatch:
    kinds = {LongType(): pa.int64(), IntegerType(): pa.int32(), BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[f.dataType])
         for f, v in zip(schema.fields, values)], names=schema.names)


def _packed(dim: int, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """Vectors in the order of their ids, so that an earlier place is a smaller id."""
    order = np.lexsort((rows, ids))
    data = np.ascontiguousarray(data[order])
    if not data.size or np.abs(data).max() < 1 << 15:
        data = data.astype(np.int16)
    return _batch(PACKED, dim, int(rows[order[0]]), data.nbytes, ids[order], rows[order], data, asked[order])


def _unpacked(ids: bytes, data: bytes, dim: int) -> np.ndarray:
    n = len(ids) // 8
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dim else np.int64).reshape(n, dim)


def _pack(size: int):
    """Vectors (``id``, ``row``, ``vector``, ``asked``) of a partition as shards of one length each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            vector = _column(batch, "vector")
            at, flat = vector.offsets.to_numpy(), vector.flatten().to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            columns = [_column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "row", "asked")]
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                data = flat[(at[here] - at[0])[:, None] + np.arange(dim)].astype(np.int64)
                mine = held.setdefault(dim, [])
                mine.append((*(c[here] for c in columns), data))
                if sum(len(x[0]) for x in mine) >= size:
                    ids, rows, asked, data = (np.concatenate(x) for x in zip(*mine))
                    for k in range(0, len(ids) - size + 1, size):
                        s = slice(k, k + size)
                        yield _packed(dim, ids[s], rows[s], data[s], asked[s])
                    k = len(ids) // size * size
                    held[dim] = [(ids[k:], rows[k:], asked[k:], data[k:])] if k < len(ids) else []
        for dim, mine in held.items():
            if mine:
                ids, rows, asked, data = (np.concatenate(x) for x in zip(*mine))
                yield _packed(dim, ids, rows, data, asked)
    return run


def _blocks(size: int):
    """The queries among the vectors of shards, gathered to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            return _packed(dim, ids, rows, data, np.ones(len(ids), bool))

        for batch in batches:
            for k in range(batch.num_rows):
                dim, ids, rows, data, asked = (
                    _column(batch, c)[k].as_py() for c in ("dim", "ids", "rows", "data", "asked"))
                here = np.flatnonzero(np.frombuffer(asked, bool))
                x = _unpacked(ids, data, dim).astype(np.int64)
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                for a in range(0, len(here), size):
                    some = here[a:a + size]
                    held.setdefault(dim, []).append((ids[some], rows[some], x[some]))
                    if sum(len(h[0]) for h in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)
    return run


def tile(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products; in doubles, where these are exact, and otherwise in whole numbers."""
    if not queries.size or not shard.size:
        return np.zeros((len(queries), len(shard)), np.int64)
    top = int(np.abs(queries).max()) * int(np.abs(shard).max()) * shard.shape[1]
    if 0 <= top < _EXACT // (2 * SHARD):
        return queries.astype(np.float64) @ shard.astype(np.float64).T
    return queries.astype(np.int64) @ shard.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each row, ties to the smaller id; best first.

    ``ids`` and ``valid`` are as wide as ``scores``; places that are not valid come last.
    """
    order = np.lexsort((ids, -scores, ~valid))
    return order[:, :k]


def select(scores: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each row, ties to the earlier place, in any order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if scores.dtype == np.float64:  # one number for score and place, exact by the bound of a tile
        key = scores * n - np.arange(n)
        key[~valid] = -np.inf
        return np.argpartition(key, n - k, axis=1)[:, n - k:]
    places = np.broadcast_to(np.arange(n), scores.shape)
    return best(scores, places, valid, k)


Lists = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, ids and whether they are there, by query


def merge(lists: list[Lists], k: int) -> Lists:
    scores, ids, valid = (np.concatenate(x, axis=1) for x in zip(*lists))
    at = best(scores, ids, valid, k)
    return tuple(np.take_along_axis(x, at, axis=1) for x in (scores, ids, valid))


def _lists(block: int, part: int, ids: np.ndarray, rows: np.ndarray, found: Lists) -> pa.RecordBatch:
    scores, others_, valid = found
    n = valid.sum(axis=1).astype(np.int32)
    # lists are sorted with what is not there at the end
    return _batch(LISTS, block, part, scores.shape[1], ids, rows, scores.astype(np.int64),
                  np.concatenate([n.view(np.uint8), others_.astype(np.int64).ravel().view(np.uint8)]))


def _read(n: int, queries: int, scores: bytes, found: bytes) -> Lists:
    counts = np.frombuffer(found[:4 * queries], np.int32)
    ids = np.frombuffer(found[4 * queries:], np.int64).reshape(queries, n)
    return np.frombuffer(scores, np.int64).reshape(queries, n), ids, np.arange(n) < counts[:, None]


def _search(k: int):
    """The lists of every block over the shards of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, tuple[np.ndarray, np.ndarray, Lists]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block, dim = _column(batch, "q_at")[r].as_py(), _column(batch, "dim")[r].as_py()
                q_ids, q_rows, q_data, s_ids, s_rows, s_data = (
                    _column(batch, c)[r].as_py() for c in ("q_ids", "q_rows", "q_data", "ids", "rows", "data"))
                scores = tile(_unpacked(q_ids, q_data, dim), _unpacked(s_ids, s_data, dim))
                ids, rows = np.frombuffer(s_ids, np.int64), np.frombuffer(s_rows, np.int64)
                mine = np.frombuffer(q_rows, np.int64)
                valid = np.ones(scores.shape, bool)
                _, own, place = np.intersect1d(mine, rows, return_indices=True)
                valid[own, place] = False
                at = select(scores, valid, k)
                new = (np.take_along_axis(scores, at, 1).astype(np.int64), ids[at], np.take_along_axis(valid, at, 1))
                lists = [held[block][2], new] if block in held else [new]
                held[block] = (np.frombuffer(q_ids, np.int64), mine, merge(lists, k))
        for block, (ids, rows, found) in held.items():
            yield _lists(block, part, ids, rows, found)
    return run


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        first = rows[0]
        n = len(first["ids"]) // 8
        found = merge([_read(r["n"], n, r["scores"], r["found"]) for r in rows], k)
        return pa.Table.from_batches([_lists(
            first["block"], first["part"], np.frombuffer(first["ids"], np.int64),
            np.frombuffer(first["rows"], np.int64), found)])
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            scores, found, valid = _read(r["n"], len(ids), r["scores"], r["found"])
            query, rank = np.nonzero(valid)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[query]), pa.array((rank + 1).astype(np.int32)), pa.array(found[valid]),
                pa.array(scores[valid])], names=FOUND.names)


def search(vectors: DataFrame, asked: Column, k: int = K, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The ``k`` vectors of the highest inner product for every query.

    ``vectors`` has an id and an array of whole numbers; queries are its rows where ``asked`` is
    true. Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``. Candidates are all rows
    but the query's own, ties go to the smaller ``vec_id``, and fewer than ``k`` candidates are
    all returned.

    Rows with a null id, a null vector or a null number take no part. Rows that repeat an id are
    several vectors and several queries. Vectors of different length are no candidates of each
    other; scores of empty ones are zero. Sums that do not fit a long wrap around. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(quoted(vector)).cast("array<long>")
    usable = vectors.select(
        F.col(quoted(vec_id)).cast("long").alias("id"), v.alias("vector"),
        F.coalesce(asked.cast("boolean"), F.lit(False)).alias("asked")).where(
        F.col("id").isNotNull() & ~F.coalesce(F.exists("vector", F.isnull), F.col("vector").isNull()))
    with Scratch(spark) as scratch:
        size = min(SHARD, max(64, vectors.count() // spark.sparkContext.defaultParallelism))
        numbered = usable.withColumn("row", F.monotonically_increasing_id())
        shards = staged(numbered.mapInArrow(_pack(size), PACKED), "shards", scratch)
        n_shards = shards.count()
        tasks = ceil(n_shards / TASK) if n_shards > TASK * spark.sparkContext.defaultParallelism else n_shards
        shards = staged(shards.repartition(max(1, tasks), "at"), "dealt", scratch)
        blocks = staged(shards.mapInArrow(_blocks(BLOCK), PACKED), "queries", scratch)
        sizes = blocks.select("at", "bytes").orderBy("at").collect()  # one row per block
        passes, room = [], 0
        for r in sizes:
            if not passes or r["bytes"] > room:
                passes.append([r["at"], r["at"]])
                room = PASS_BYTES
            passes[-1][1] = r["at"]
            room -= r["bytes"]
        merged = []
        for first, last in passes:
            some = blocks.where(F.col("at").between(first, last)).select(
                "dim", F.col("at").alias("q_at"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"),
                F.col("data").alias("q_data"))
            tiles = shards.select("dim", "ids", "rows", "data").join(F.broadcast(some), "dim")
            lists = staged(tiles.mapInArrow(_search(k), LISTS), "lists", scratch)
            parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
            while parts > 1:
                lists = staged(lists.groupBy("block", F.floor(F.col("part") / FAN).alias("up")).applyInArrow(
                    _merge(k), LISTS).withColumn("part", F.floor(F.col("part") / FAN)), "lists", scratch)
                parts = ceil(parts / FAN)
            merged.append(lists)
        out = spark.createDataFrame([], LISTS) if not merged else merged[0]
        for more in merged[1:]:
            out = out.unionByName(more)
        return staged(out.mapInArrow(_rows, FOUND), "found")


def scaled(vector: str = "embedding", by: int = 64) -> Column:
    """Each component times ``by``, rounded down, as a whole number; null for a vector that is null
    or holds a null or a number that is not finite. What does not fit a long becomes its nearest."""
    x = F.col(quoted(vector)).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = float(1 << 62)
    whole = F.transform(x, lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(c * by).cast("double"))).cast("long"))
    return F.when(~odd, whole)
