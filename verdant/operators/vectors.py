"""Exact nearest neighbours between two tables of vectors, block by block.

Vectors are scaled to length one, where cosine distance is half the squared
Euclidean distance and the triangle inequality holds. Every row goes to the
nearest of ``PIVOTS`` corpus vectors, and tasks pack the rows of a pivot as
matrices of at most ``BLOCK_BYTES`` with the greatest distance to the pivot
(the radius). Then two joins of packed blocks on the pivot:

1. queries meet the blocks of their own pivot; the k-th best distance there is
   an upper bound of the k-th best of all;
2. queries meet the blocks of every pivot that could hold something nearer:
   distance to the pivot less radius within the bound. Rows within the bound
   are passed on, at most k (and ties) a block.

What is passed on is scored once more, and ranked, by the exact distances. The
plan has one size whatever the number of queries, no query or corpus vector
goes through the driver (it sees the pivots and a radius each), and a pivot's
blocks are dealt over ``SALTS`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIVOTS = 32
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 32 << 20        # of one Arrow batch: some pairs of blocks
SALTS = 8
SLACK = 1e-9                  # distances that rounding may tell apart the wrong way


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _packed_type(key: T.DataType, extra: list[T.StructField] = ()) -> T.StructType:
    return T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("salt", T.IntegerType()), *extra,
                         T.StructField("keys", T.ArrayType(key)), T.StructField("rows", T.BinaryType())])


def pivots_of(units: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """``n`` vectors of ``units`` (key, unit), by the hash of their keys."""
    rows = units.orderBy(F.xxhash64("key"), "key").limit(n).select("unit").collect()
    return np.array([r.unit for r in rows], float)


def corpus_blocks(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """pivot, salt, radius, keys, rows (packed float64) of all of ``units``."""
    limit = max(16, BLOCK_BYTES // (8 * pivots.shape[1]))
    names = ["pivot", "salt", "radius", "keys", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def block(p: int) -> pa.RecordBatch:
            nonlocal made
            keys, rows, apart = zip(*held.pop(p))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([made % SALTS], pa.int32()), pa.array([max(a.max() for a in apart)]),
                 pa.ListArray.from_arrays(pa.array([0, sum(map(len, keys))], pa.int32()), pa.concat_arrays(keys)),
                 pa.array([np.concatenate(rows).tobytes()], pa.binary())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), pivots.shape[1])
            apart = _to_pivots(x, pivots)
            at = apart.argmin(axis=1)
            for p in np.unique(at).tolist():
                mine = np.flatnonzero(at == p)
                for k in range(0, len(mine), limit):
                    i = mine[k:k + limit]
                    held.setdefault(p, []).append((b.column(0).take(pa.array(i)), x[i], apart[i, p]))
                    if sum(len(h[1]) for h in held[p]) >= limit:
                        yield block(p)
        for p in list(held):
            yield block(p)

    return units.select("key", "unit").mapInArrow(run, _packed_type(units.schema["key"].dataType, [T.StructField("radius", T.DoubleType())]))


def query_blocks(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray | None) -> DataFrame:
    """Packed queries (key, unit, and ``bound`` with ``radii``) by the pivot they
    have to look at: their own, or every one within reach; a copy for each salt.
    Packed rows are the vector and the bound."""
    width = pivots.shape[1]
    limit = max(16, BLOCK_BYTES // (16 * width))
    names = ["pivot", "salt", "keys", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width)
            apart = _to_pivots(x, pivots)
            bound = np.full(len(x), np.inf) if radii is None else b.column(2).to_numpy(zero_copy_only=False)
            at = apart.argmin(axis=1)
            for p in range(len(pivots)):
                near = at == p if radii is None else apart[:, p] - radii[p] <= bound + 1e-6
                for i in np.split(np.flatnonzero(near), range(limit, int(near.sum()), limit)):
                    if len(i):
                        keys = b.column(0).take(pa.array(i))
                        packed = np.column_stack([x[i], bound[i]]).tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p] * SALTS, pa.int32()), pa.array(range(SALTS), pa.int32()),
                             pa.ListArray.from_arrays(pa.array(np.arange(SALTS + 1) * len(i), pa.int32()), pa.concat_arrays([keys] * SALTS)),
                             pa.array([packed] * SALTS, pa.binary())], names=names)

    cols = ["key", "unit"] if radii is None else ["key", "unit", "bound"]
    return queries.select(*cols).mapInArrow(run, _packed_type(queries.schema["key"].dataType))


def _met(q: DataFrame, c: DataFrame) -> DataFrame:
    return (q.withColumnsRenamed({"keys": "q_keys", "rows": "q_rows"})
            .join(c.withColumnsRenamed({"keys": "c_keys", "rows": "c_rows"}).drop("radius"), ["pivot", "salt"])
            .select("q_keys", "q_rows", "c_keys", "c_rows"))


def _distances(b: pa.RecordBatch, i: int, width: int, exclude_self: bool) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Query keys, their bounds, corpus keys and Euclidean distances of one pair of blocks."""
    q_keys, c_keys = b.column(0)[i].values, b.column(2)[i].values
    q = np.frombuffer(b.column(1)[i].as_buffer()).reshape(len(q_keys), width + 1)
    c = np.frombuffer(b.column(3)[i].as_buffer()).reshape(len(c_keys), width)
    d = _to_pivots(q[:, :-1], c)
    if exclude_self:
        own = pc.index_in(q_keys.cast(c_keys.type), value_set=c_keys)
        has = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
        d[has, own.fill_null(0).to_numpy(zero_copy_only=False)[has]] = np.inf
    return q_keys, q[:, -1], c_keys, d


def candidates(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query, key) pairs among which the k nearest rows of ``corpus`` (key,
    unit) to each of ``queries`` (key, unit) are, with all that tie."""
    corpus.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))      # rows are blocks
    pivots = pivots_of(corpus)
    q_type, c_type = queries.schema["key"].dataType, corpus.schema["key"].dataType
    out = T.StructType([T.StructField("query", q_type), T.StructField("key", c_type)])
    if not len(pivots):
        return corpus.sparkSession.createDataFrame([], out)
    width = pivots.shape[1]
    blocks = corpus_blocks(corpus, pivots).checkpoint(eager=True)
    radii = np.zeros(len(pivots))
    for r in blocks.groupBy("pivot").agg(F.max("radius").alias("radius")).collect():
        radii[r.pivot] = r.radius

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_keys, _, c_keys, d = _distances(b, i, width, exclude_self)
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(c_keys) >= k else np.full(len(q_keys), np.inf)
                yield pa.RecordBatch.from_arrays([q_keys, pa.array(kth)], names=["key", "bound"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_keys, bound, c_keys, d = _distances(b, i, width, exclude_self)
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(c_keys) > k else np.full(len(q_keys), np.inf)
                # of equal cosines the roots differ by less than the root of the slack
                limit = np.minimum(bound, kth)
                row, col = np.nonzero((d * d <= limit[:, None] ** 2 + 4 * SLACK) & (d < np.inf))
                if len(row):
                    yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(row)), c_keys.take(pa.array(col))], names=["query", "key"])

    kth = (_met(query_blocks(queries, pivots, None), blocks)
           .mapInArrow(bounds, T.StructType([T.StructField("key", q_type), T.StructField("bound", T.DoubleType())]))
           .groupBy("key").agg(F.min("bound").alias("bound")))
    bounded = queries.join(kth, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return _met(query_blocks(bounded, pivots, radii), blocks).mapInArrow(within, out)
