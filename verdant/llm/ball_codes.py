"""Operator 11 — vector code compression: product codes by ball k-means.

A vector's components become integers, ``floor(1024 x)``, and its ``parts``
equal consecutive parts are coded each by the nearest entry of a codebook,
which k-means refines in integer arithmetic; all comparisons are exact.

One round is one pass of tasks over the packed vectors and their codes of the
round before. The parts an entry had form a ball around it: its radius is the
greatest distance to them, in the stretch of rows a task holds. An entry j can
win a part of ball i only if half the distance of the entries i and j does not
exceed the part's distance to i, so only entries within twice the radius are
neighbours of the ball; parts nearer to their entry than half the way to its
nearest neighbour (the stable core) need no comparison at all, and those
beyond lie in rings between the half distances of neighbours sorted by
distance: a part in the k-th ring is compared with the first k alone. A ball
of one stretch is smaller than the ball of all its parts, and as exact. The
pass writes the new codes, then the sums and counts of each entry's parts are
added by Spark; what reaches the driver are the codebooks.

Defined cases: rows whose vector is null or empty, holds a null or non-finite
component, or one of ``TOO_LARGE`` or more in magnitude (its squares could not
be added as long) are dropped. The dimension is that of most kept rows, the
greatest of equals; rows of another one are dropped too. Where the dimension
is no multiple of ``parts`` the last parts are shorter. Equal vec_ids are
ordered by their components, null ids come last; repeated rows are coded alike.
With fewer rows than entries a codebook has as many entries as rows, an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import arrow_map, drop_stored, prepare, stored

SCALE = 1024
TOO_LARGE = float(1 << 16)    # components from here on: squares of 512 such differences still add up below 2 ** 63
STRETCH_ROWS = 8_192          # rows whose balls are measured together
SALTS = 16
_EXACT = float(1 << 53)
_SHIFT = 1 << 31


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of every part; the first ones are the longer where ``parts`` does not divide ``dim``."""
    size, more = divmod(dim, parts)
    ends = np.cumsum([size + (p < more) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _components(ints: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(ints), ">u4").astype(np.int64).reshape(len(ints), dim) - _SHIFT


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and the integer components (4 bytes each, shifted and
    big-endian, so that they sort as bytes) of the rows that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("embedding")
            lens = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows.flatten()                                     # of null rows nothing
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = ~(np.abs(x) < TOO_LARGE)
            ends = np.cumsum(lens)
            wrong = np.append(0, np.cumsum(bad))
            keep = np.flatnonzero((lens > 0) & (wrong[ends] == wrong[ends - lens]))
            whole = (np.floor(np.where(bad, 0, x) * SCALE).astype(np.int64) + _SHIFT).astype(">u4")
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), b.column("label").take(at), pa.array(lens[keep], pa.int32()),
                 pa.array([whole[ends[i] - lens[i]:ends[i]].tobytes() for i in keep.tolist()], pa.binary())],
                names=["vec_id", "label", "dim", "ints"])

    picked = vectors.select(F.col("vec_id").cast("bigint"), "label", F.col("embedding").cast("array<double>"))
    kind = picked.schema["label"].dataType.simpleString()
    return arrow_map(picked, run, f"vec_id bigint, label {kind}, dim int, ints binary")


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c`` (int64)."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4.0 * x.shape[1] * float(most) ** 2 < _EXACT:                  # every sum is a whole number below 2 ** 53
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals) and squared distance, by comparing all."""
    codes, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for k in range(0, len(x), STRETCH_ROWS):
        d = distances(x[k:k + STRETCH_ROWS], book)
        codes[k:k + STRETCH_ROWS] = d.argmin(1)
        error[k:k + STRETCH_ROWS] = d.min(1)
    return codes, error


def nearest_in_balls(x: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, for parts whose entries were ``before``; also the number of distances computed."""
    codes, error = before.copy(), ((x - book[before]) ** 2).sum(1)
    entries, looked = distances(book, book), len(x)
    order = np.argsort(before, kind="stable")
    cuts = np.flatnonzero(np.diff(before[order])) + 1
    for ball in np.split(order, cuts):
        if not len(ball):
            continue
        i = int(before[ball[0]])
        reach = 4 * error[ball]
        apart = entries[i].copy()
        apart[i] = -1
        near = np.flatnonzero(apart <= reach.max())                    # the neighbours, and the entry itself
        near = near[np.argsort(apart[near], kind="stable")]
        ring = np.searchsorted(apart[near], reach, side="right")       # entries a part is compared with
        outside = ring > 1
        ball, ring = ball[outside], ring[outside]
        by_ring = np.argsort(ring, kind="stable")
        ball, ring = ball[by_ring], ring[by_ring]
        done = 0
        while done < len(ball):
            stop = int(np.searchsorted(ring, 2 * ring[done], side="right"))
            some, width = ball[done:stop], int(ring[stop - 1])
            group = np.sort(near[:width])                               # the lowest index wins ties
            d = distances(x[some], book[group])
            best = d.argmin(1)
            codes[some], error[some] = group[best], d[np.arange(len(some)), best]
            looked += d.size
            done = stop
    return codes, error, looked


def assign(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """vec_id, label, ints, code (one byte an entry) and error of every row;
    ``rows`` with a code are assigned from the balls of those codes."""
    shared = rows.sparkSession.sparkContext.broadcast(books)           # entries x dimension
    bounds = part_bounds(dim, len(books))
    again = "code" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def code(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            x = _components(table["ints"].to_pylist(), dim)
            old = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(n, -1).astype(np.int64) if again else None
            codes, total = np.empty((n, len(bounds)), np.uint8), np.zeros(n, np.int64)
            for p, (lo, hi) in enumerate(bounds):
                found = nearest(x[:, lo:hi], shared.value[p]) if old is None else nearest_in_balls(x[:, lo:hi], shared.value[p], old[:, p])
                codes[:, p] = found[0]
                total += found[1]
            out = pa.Table.from_arrays(
                [table["vec_id"], table["label"], table["ints"], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(total)],
                names=["vec_id", "label", "ints", "code", "error"])
            yield from out.to_batches(max_chunksize=STRETCH_ROWS)

        held, rows_held = [], 0
        for b in batches:
            held.append(b)
            rows_held += b.num_rows
            if rows_held >= STRETCH_ROWS:
                yield from code(held)
                held, rows_held = [], 0
        if rows_held:
            yield from code(held)

    kind = rows.schema["label"].dataType.simpleString()
    return arrow_map(rows, run, f"vec_id bigint, label {kind}, ints binary, code binary, error bigint")


def refined(coded: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after every entry is replaced by the floored mean of its parts."""
    bounds = part_bounds(dim, len(books))
    widest = max(hi - lo for lo, hi in bounds)
    sizes = [len(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, hi - lo), np.int64) for k, (lo, hi) in zip(sizes, bounds)]
        counts = [np.zeros(k, np.int64) for k in sizes]
        for b in batches:
            x = _components(b.column("ints").to_pylist(), dim)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for p, (lo, hi) in enumerate(bounds):
                np.add.at(sums[p], codes[:, p], x[:, lo:hi])
                counts[p] += np.bincount(codes[:, p], minlength=sizes[p])
        for p, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(n[used]),
                     pa.array([row.tolist() + [0] * (widest - s.shape[1]) for row in s[used]], pa.list_(pa.int64()))],
                    names=["part", "entry", "n", "sums"])

    partial = arrow_map(coded.select("ints", "code"), run, "part int, entry int, n bigint, sums array<bigint>")
    totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(widest)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in totals.collect():                                         # as many rows as entries
        lo, hi = bounds[r.part]
        out[r.part][r.entry] = np.array(r.sums[:hi - lo], np.int64) // r.n
    return out


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame | None, list[np.ndarray]]:
    """vec_id, label, code, error of every kept row (one byte a part) and the
    final codebooks; None and no codebooks where no row is kept."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("up to 256 entries, at least one part")
    prepare(vectors.sparkSession)
    table = stored(packed(vectors), "vectors")
    dims = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return None, []
    dim = dims[0].dim
    rows = table.where(F.col("dim") == dim).drop("dim")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    start = _components([r.ints for r in first], dim)
    books = [start[:, lo:hi].copy() for lo, hi in part_bounds(dim, parts)]
    for _ in range(rounds):
        coded = stored(assign(rows, books, dim), "codes")
        books = refined(coded, books, dim)
        drop_stored(table)
        table, rows = coded, coded.drop("error")
    coded = stored(assign(rows, books, dim).drop("ints"), "codes")
    drop_stored(table)
    return coded, books


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of every kept row."""
    spark = vectors.sparkSession
    coded, books = fit(vectors)
    if coded is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                          F.lit(sha).alias("codebooks_sha256"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The sum of ``error`` over the rows of equal label beside each row; a hot label's rows are dealt over SALTS tasks."""
    sums = (coded.groupBy("label").agg(F.sum("error").alias("label_error"))
            .select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["salt"] == sums["part"]))
