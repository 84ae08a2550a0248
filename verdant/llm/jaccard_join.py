"""Operator 3 — n-gram Jaccard self-join, size-aware heavy-light.

A document's set holds its distinct shingles of ``width`` words. Documents with
equal sets form a class; classes are joined, copies are not. Two sets of Jaccard
similarity s share, under any common order of shingles, ``c`` of the first
``n - ceil(s n) + c`` (the prefix of a set of size n). Width and similarity are
arguments (``Likeness``): 4 words and 0.85 unless the caller says otherwise. The order puts
shingles that many classes have last: all shingles are counted, by 40 bits of
their hashes, and filters of fixed size hold those of at least as many classes
as keeps the first sparse, and of some times as many. A wrong member only
costs order, never a result.

* Light sets (size up to a boundary) enumerate the 2-subsets of their prefix
  (c = 2) and meet in equal subsets.
* Heavy sets scan inverted lists of single prefix shingles (c = 1), in which
  light sets large enough to be similar to a heavy one are listed too.

The boundary minimises the entries of subsets and lists, each weighted by the
companions it can expect, over the measured sizes. Equal keys are found by
parts of the key space with packed arrays; keys of frequent shingles are dealt
over several parts.

A pair that shares a key is a candidate when the sizes, and the places of the
key in both prefixes, leave room for enough common shingles; keys whose classes
have no such partner end there. Short lists give their candidates at once. Long
ones link their members to one leader each, links are verified on the whole
sets, and lists whose members are not yet connected elect another leader. When
that no longer pays, the members of a list are packed into blocks of ``BLOCK``
and blocks meet blocks, spread over tasks, trying pairs of different components
alone, so no link between different components is lost. Before whole sets are
fetched, pairs are tried on parity bitmaps: sets differ in at least as many
shingles as their bitmaps in bits, so too many bits rule a pair out for certain.

Defined cases: a null or empty text, or one without words, has the empty set
and is linked with nothing; a text of fewer words than a shingle has one shingle;
repeated rows are copies; a null doc_id takes part, and a component's id is its
smallest non-null id; other columns pass through ``keep_one``. There a row is
known by its id and its text: an id that stands on unlike texts keeps one row
of each component, a component of rows without id keeps one of them, equal rows
of one component leave one, and texts without words all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import (FILTER_BITS, arrow_map, bit_filter, components, drop_stored, fresh, in_filter, mix64,
                                partitions, prepare, shingle_hashes, stored)


@dataclass(frozen=True)
class Likeness:
    """Sets of shingles of ``width`` words, similar from ``num / den`` on."""
    width: int = 4
    num: int = 85
    den: int = 100

    def __post_init__(self):
        if self.width < 1 or not self.den < 2 * self.num < 2 * self.den:     # two shared shingles need more than a half
            raise ValueError("width must be positive and similarity between 1/2 and 1")

    @property
    def least(self) -> int:
        """Smaller sets are similar to equal ones only."""
        return -(-self.num // (self.den - self.num))

    def overlap_needed(self, n):
        return (self.num * n + self.den - 1) // self.den

    def prefix_length(self, n, c: int):
        return n - self.overlap_needed(n) + c


CONTRACT = Likeness()         # of the query op3_jaccard_join
LEAST = CONTRACT.least
STRETCH = 2_000_000           # shingles sorted and sent together when they are counted
SLOT_BITS = 40                # of a shingle's hash by which it is counted
LEVELS = (2, 3, 4, 6, 8, 12, 16, 32, 64, 256, 1024)   # classes from which on a shingle may count as frequent
PART_ROWS = 1_000_000         # entries of one part of the key space
SALTS = 16
LONG_LIST = 1000              # entries beyond which a key's list is dealt over SALTS tasks
SHORT_LIST = 4                # classes of a key up to which its candidates are listed at once
BLOCK = 2048                  # members of a long list that are compared with as many others in one task
BITMAP = 1024                 # bits of a set's parity bitmap
MAX_LIGHT = 64                # sizes considered for the boundary


def _sets(b: pa.RecordBatch, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text (sorted), their number, and a hash of the set."""
    hashes, counts, _ = shingle_hashes(b.column("text"), width)
    sets = []
    for x in np.split(hashes, np.cumsum(counts)[:-1]):
        x = np.sort(x)
        sets.append(x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x)
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(mix64(np.concatenate(sets))))
        cls = mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
    return sets, sizes, cls


def _bitmaps(sets: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    cell = np.repeat(np.arange(len(sizes)) * BITMAP, sizes) + (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) % BITMAP
    odd = (np.bincount(cell, minlength=len(sizes) * BITMAP) & 1).astype(np.uint8).reshape(len(sizes), BITMAP)
    return [row.tobytes() for row in np.packbits(odd, axis=1)]


def read_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, mark (hash of the text), class (set hash), n, bits (parity bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets, sizes, cls = _sets(b, like.width)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("mark"), pa.array(cls.view(np.int64)), pa.array(sizes, pa.int64()),
                     pa.array(_bitmaps(sets, sizes), pa.binary())], names=["doc_id", "mark", "class", "n", "bits"])

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), run,
                     "doc_id bigint, mark bigint, class bigint, n bigint, bits binary")


def frequent(docs: DataFrame, total: int, like: Likeness) -> tuple[list[np.ndarray], float]:
    """Filters (see ``in_filter``) of the shingles that many, more and still
    more classes share, and the share of all shingles that occur in several
    classes."""
    spark = docs.sparkSession
    bits = 6
    while bits < 20 and total >> bits > PART_ROWS:
        bits += 1                                                   # 2 ** bits parts of the hash space
    low = np.uint64((1 << (SLOT_BITS - bits)) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held) >> np.uint64(64 - SLOT_BITS))
            kinds, at = np.unique(slots >> np.uint64(SLOT_BITS - bits), return_index=True)
            # within a part the slots ascend: differences are short
            blobs = [np.diff(x & low, prepend=np.uint64(0)).astype(np.uint32 if SLOT_BITS - bits <= 32 else np.uint64).tobytes()
                     for x in np.split(slots, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "slots"])

        for b in batches:
            sets, _, cls = _sets(b, like.width)
            for s, c in zip(sets, cls.tolist()):
                if len(s) >= like.least and c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size >= STRETCH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def flush() -> pa.RecordBatch:
            slots, times = np.unique(np.concatenate(held), return_counts=True)
            words = FILTER_BITS // 64 >> bits
            place = slots >> np.uint64(SLOT_BITS - 26)               # the filter's bit, from the part's first on
            pieces, members = [], []
            for level in LEVELS:
                piece = np.zeros(words, np.uint64)
                at = place[times >= level]
                np.bitwise_or.at(piece, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                pieces.append(piece.tobytes())
                members.append(len(at))
            several = int(times[times >= 2].sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(LEVELS)), pa.array(list(range(len(LEVELS)))), pa.array(members, pa.int64()),
                 pa.array([several] * len(LEVELS), pa.int64()), pa.array(pieces, pa.binary())],
                names=["part", "level", "members", "several", "piece"])

        for b in batches:
            for k, blob in zip(b.column("part").to_pylist(), b.column("slots").to_pylist()):
                if k != part and held:
                    yield flush()
                    held = []
                part = k
                held.append(np.cumsum(np.frombuffer(blob, np.uint32 if SLOT_BITS - bits <= 32 else np.uint64), dtype=np.uint64))
        if held:
            yield flush()

    tasks = max(partitions(spark), min(1 << bits, 4 * partitions(spark)))
    dealt = arrow_map(docs.select("doc_id", "text"), deal, "part bigint, slots binary")
    pieces = stored(arrow_map(dealt.repartition(tasks, "part").sortWithinPartitions("part"), count,
                              "part bigint, level bigint, members bigint, several bigint, piece binary"), "frequent")
    sums = {r.level: r for r in pieces.groupBy("level").agg(F.sum("members").alias("members"), F.sum("several").alias("several")).collect()}
    if not sums:
        return [], 0.0
    level = next((k for k in range(len(LEVELS)) if sums[k].members <= FILTER_BITS // 8), len(LEVELS) - 1)
    words, filters = FILTER_BITS // 64 >> bits, []
    for k in range(level, len(LEVELS)):
        if k == level or LEVELS[k] >= 4 * LEVELS[level]:
            level, out = k, np.zeros(FILTER_BITS // 64, np.uint64)
            for r in pieces.where(F.col("level") == k).select("part", "piece").collect():      # FILTER_BITS in all
                out[r.part * words:(r.part + 1) * words] = np.frombuffer(r.piece, np.uint64)
            filters.append(out)
    return filters, sums[0].several / max(1, total)


def boundary(histogram: dict[int, int], companions: float, like: Likeness = CONTRACT) -> int:
    """The size up to which sets are light: least cost of subset entries and
    list entries, each with the companions it can expect."""

    def cost(x: int) -> float:
        out = 0.0
        for n, count in histogram.items():
            if n < like.least:
                continue
            p = like.prefix_length(n, 2)
            if n <= x:
                out += count * (p * (p - 1) / 2) * (1 + companions ** 2)
            if n >= like.overlap_needed(x + 1):
                out += count * like.prefix_length(n, 1) * (1 + companions)
        return out

    return min(range(like.least - 1, MAX_LIGHT + 1), key=cost)


def _entries(s: np.ndarray, filters: list[np.ndarray], x: int, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set, the shingles that may still be common when a key is the
    first common one, and whether each is built of very frequent shingles only."""
    n = len(s)
    often = np.zeros(n, np.int64)
    for f in filters:
        often += in_filter(f, s)
    order = np.argsort(often, kind="stable")              # the rarest first
    keys, room, hot = [], [], []
    with np.errstate(over="ignore"):
        if n <= x:
            at = order[:like.prefix_length(n, 2)]
            i, j = np.triu_indices(len(at), 1)
            lo, hi = np.minimum(s[at][i], s[at][j]), np.maximum(s[at][i], s[at][j])
            keys.append(mix64(lo * np.uint64(0x9E3779B97F4A7C15) ^ hi))
            room.append(n - j + 1)
            hot.append(np.minimum(often[at][i], often[at][j]) > 2)
        if n >= like.overlap_needed(x + 1):
            at = order[:like.prefix_length(n, 1)]
            keys.append(s[at])
            room.append(n - np.arange(len(at)))
            hot.append(often[at] > 2)
    return np.concatenate(keys), np.concatenate(room), np.concatenate(hot)


_ROW = np.dtype([("key", "<u8"), ("class", "<u8"), ("n", "<u4"), ("room", "<u4")])
_HOT = np.uint32(1 << 31)     # beside the room


def _fit(like: Likeness, n_a, n_b, room=None):
    """Whether sets of these sizes, with so much room for common shingles, can be similar."""
    ok = like.den * np.minimum(n_a, n_b) >= like.num * np.maximum(n_a, n_b)
    return ok if room is None else ok & (room * (like.num + like.den) >= like.num * (n_a + n_b))


def shared_entries(docs: DataFrame, filters: list[np.ndarray], x: int, parts: int, like: Likeness) -> DataFrame:
    """Candidates and lists: rows without key are pairs of classes (a, b) with
    their sizes, rows with key say that class a is in the key's list."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            with np.errstate(over="ignore"):
                salt = np.where(rows["room"] & _HOT, rows["class"] % np.uint64(SALTS), np.uint64(0))
                part = (mix64(rows["key"] + salt * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            kinds, at = np.unique(part[order], return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int64()), pa.array([x.tobytes() for x in np.split(rows[order], at[1:])], pa.binary())],
                names=["part", "rows"])

        for b in batches:
            sets, sizes, cls = _sets(b, like.width)
            for s, c in zip(sets, cls.tolist()):
                if len(s) < like.least or c in seen:
                    continue
                seen.add(c)
                keys, room, often = _entries(s, shared.value, x, like)
                rows = np.empty(len(keys), _ROW)
                rows["key"], rows["class"], rows["n"], rows["room"] = keys, c, len(s), room | np.where(often, _HOT, 0)
                held.append(rows)
                size += len(rows)
            if size >= STRETCH // 4:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["class"], rows["n"], rows["key"]))]
            twice = np.append(False, (rows["key"][1:] == rows["key"][:-1]) & (rows["class"][1:] == rows["class"][:-1]))
            rows = rows[~twice]                                    # copies met in several tasks
            hot = rows["room"] & _HOT != 0
            fits = (rows["key"][1:] == rows["key"][:-1]) & _fit(like, rows["n"][1:].astype(np.int64), rows["n"][:-1].astype(np.int64))
            rows = rows[np.append(fits, False) | np.append(False, fits) | hot]     # some neighbour by size, if any, is near enough
            if not len(rows):
                return
            hot = rows["room"] & _HOT != 0
            cut = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
            members = np.diff(np.append(cut, len(rows)))
            long = np.repeat(members > SHORT_LIST, members) | hot
            key, cls, n = rows["key"], rows["class"].view(np.int64), rows["n"].astype(np.int64)
            room = (rows["room"] & ~_HOT).astype(np.int64)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(1, SHORT_LIST):
                if len(rows) <= k:
                    break
                i = np.flatnonzero((key[k:] == key[:-k]) & ~long[:-k])
                i = i[_fit(like, n[i], n[i + k], np.minimum(room[i], room[i + k]))]
                swap = cls[i] > cls[i + k]
                a.append(np.where(swap, i + k, i))
                b.append(np.where(swap, i, i + k))
            a, b = np.concatenate(a), np.concatenate(b)
            at = np.flatnonzero(long)
            for first, second in ((at, None), (a, b)):
                for k in range(0, len(first), 100_000):
                    i = first[k:k + 100_000]
                    j = None if second is None else second[k:k + 100_000]
                    none = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[i].view(np.int64)) if j is None else none, pa.array(cls[i]), none if j is None else pa.array(cls[j]),
                         pa.array(n[i]), none if j is None else pa.array(n[j])], names=["key", "a", "b", "n_a", "n_b"])

        for b in batches:
            for k, blob in zip(b.column("part").to_pylist(), b.column("rows").to_pylist()):
                if k != part and held:
                    yield from flush()
                    held = []
                part = k
                held.append(np.frombuffer(blob, _ROW))
        if held:
            yield from flush()

    dealt = arrow_map(docs.select("doc_id", "text"), deal, "part bigint, rows binary")
    return arrow_map(dealt.repartition(max(partitions(spark), min(parts, 4 * partitions(spark))), "part").sortWithinPartitions("part"),
                     meet, "key bigint, a bigint, b bigint, n_a bigint, n_b bigint")


def candidate_sets(docs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """class, shingles (sorted hashes, packed) of the classes named."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(classes, "class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets, sizes, cls = _sets(b, like.width)
            pick = np.flatnonzero((sizes >= like.least) & in_filter(wanted.value, cls))
            pick = [i for i in pick.tolist() if int(cls[i]) not in seen]
            seen.update(int(cls[i]) for i in pick)
            if pick:
                first = list({int(cls[i]): i for i in pick}.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[first].view(np.int64)), pa.array([sets[i].tobytes() for i in first], pa.binary())],
                    names=["class", "shingles"])

    found = arrow_map(docs.select("doc_id", "text"), run, "class bigint, shingles binary")
    return found.join(classes, "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"))


def possible(pairs: DataFrame, bitmaps: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose parity bitmaps do not rule them out."""
    a = bitmaps.select(F.col("class").alias("a"), F.col("bits").alias("bits_a"))
    b = bitmaps.select(F.col("class").alias("b"), F.col("bits").alias("bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = total - 2 * (-(-like.num * total // (like.num + like.den)))
            keep = pa.array(np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1) <= most))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return arrow_map(pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a bigint, b bigint")


def similar(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if like.den * both >= like.num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())),
                                              batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return arrow_map(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b"), run, "a bigint, b bigint")


_MEMBER = np.dtype([("class", "<i8"), ("root", "<i8"), ("n", "<i8"), ("bits", "<u8", (BITMAP // 64,))])


def _compare(like: Likeness, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pairs of two blocks (or of one: each pair once) in
    different components whose sizes and bitmaps let them be similar."""
    a, b, one = [np.empty(0, np.int64)], [np.empty(0, np.int64)], x is y
    for k in range(0, len(x), 64):
        part = x[k:k + 64]
        open_ = (part["root"][:, None] != y["root"]) & _fit(like, part["n"][:, None], y["n"])
        if one:
            open_ &= np.arange(k, k + len(part))[:, None] < np.arange(len(y))
        i, j = np.nonzero(open_)
        total = part["n"][i] + y["n"][j]
        left = total - 2 * (-(-like.num * total // (like.num + like.den)))     # bits that may differ
        for lo, hi in ((0, 4), (4, BITMAP // 64)):                            # most pairs end at the first words
            left = left - np.bitwise_count(part["bits"][i, lo:hi] ^ y["bits"][j, lo:hi]).sum(axis=1, dtype=np.int64)
            keep = left >= 0
            i, j, left = i[keep], j[keep], left[keep]
        a.append(part["class"][i])
        b.append(y["class"][j])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def pairs_in_blocks(lists: DataFrame, bitmaps: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): the pairs of ``lists`` (key, class, n, root, all) across
    components that bitmaps do not rule out, all members compared with all, a
    block with a block in a task."""
    spark = lists.sparkSession
    rows = lists.join(bitmaps, "class").select(
        "key", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), "class", "root", "n", "bits")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], read: Callable[[pa.RecordBatch], list]) -> Iterator:
        at, held = None, []
        for b in batches:
            for k, x in zip(zip(*(b.column(c).to_pylist() for c in names)), read(b)):
                if k != at and held:
                    yield at, held
                    held = []
                at = k
                held.append(x)
        if held:
            yield at, held

    def members(b: pa.RecordBatch) -> list[np.ndarray]:
        out = np.empty(b.num_rows, _MEMBER)
        for c in ("class", "root", "n"):
            out[c] = b.column(c).to_numpy()
        out["bits"] = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, -1)
        return list(out)

    def found(like: Likeness, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b = _compare(like, x, y)
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], names=names)

    names = ["a", "b", "blocks", "block", "members"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, blocks, block), held in groups(batches, ("key", "blocks", "block"), members):
            x = np.array(held, _MEMBER)
            if blocks == 1:
                yield found(like, x, x)
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.nulls(1, pa.int64()), pa.array([blocks], pa.int32()), pa.array([block], pa.int32()),
                     pa.array([x.tobytes()], pa.binary())], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, ("key", "lo", "hi"), lambda b: b.column("members").to_pylist()):
            x = np.frombuffer(held[0], _MEMBER)
            yield found(like, x, np.frombuffer(held[1], _MEMBER) if len(held) > 1 else x)

    schema = "a bigint, b bigint, blocks int, block int, members binary"
    dealt = rows.repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block")
    packed = stored(arrow_map(dealt.select("key", "blocks", "block", "class", "root", "n", "bits"), pack, schema), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (packed.where("block is not null").select(F.col("a").alias("key"), "block", "members", other)
             .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "members"))
    met = arrow_map(dealt.repartition(4 * partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"), meet, schema)
    return packed.where("block is null").select("a", "b").unionByName(met.select("a", "b")).distinct()


def link_classes(entries: DataFrame, bitmaps: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame | None:
    """class, root: the components of similar classes among ``entries``."""
    owner, before = None, None
    listed = entries.where("key is not null").select("key", F.col("a").alias("class"), F.col("n_a").alias("n"))
    direct = entries.where("key is null").select("a", "b", "n_a", "n_b")
    links, tables, last = [], [], False
    for turn in range(1 << 30):
        lists = listed.join(owner, "class", "left") if owner is not None else listed
        lists = lists.withColumn("root", F.coalesce("root", "class") if owner is not None else F.col("class"))
        by_root = lists.groupBy("key", "root").count()
        open_keys = stored(by_root.groupBy("key").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("own"))
                           .withColumn("pairs", (F.col("all") * F.col("all") - F.col("own")) / 2).where("pairs > 0"), "open")
        left, rows = open_keys.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        if not left and turn:
            break
        lists = stored(lists.join(open_keys.select("key", "all"), "key"), "lists")         # the others need no further look
        last = left <= 16 * rows or (before is not None and left > 0.5 * before)
        before = left
        if last:
            close = pairs_in_blocks(lists, bitmaps, like)
            if not turn:
                close = close.unionByName(possible(direct.distinct(), bitmaps, like)).distinct()
        else:
            salts = F.when(F.col("all") > LONG_LIST, F.lit(SALTS)).otherwise(F.lit(1))
            salted = lists.withColumn("salts", salts).withColumn("salt", F.pmod(F.col("class"), F.col("salts")).cast("int"))
            leader = (salted.groupBy("key", "salts")
                      .agg(F.min_by(F.struct("class", "n", "root"), F.xxhash64("class", F.lit(turn))).alias("l"))
                      .select("key", "l", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
            first = F.col("class") < F.col("l.class")
            pairs = (salted.join(leader, ["key", "salt"]).where("root <> l.root")
                     .select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b"),
                             F.when(first, F.col("n")).otherwise(F.col("l.n")).alias("n_a"),
                             F.when(first, F.col("l.n")).otherwise(F.col("n")).alias("n_b"))
                     .where(f"{like.den} * least(n_a, n_b) >= {like.num} * greatest(n_a, n_b)"))
            close = possible((pairs if turn else pairs.unionByName(direct)).distinct(), bitmaps, like)
        close = stored(close, "close")
        both = close.select(F.col("a").alias("class")).distinct().unionByName(close.select(F.col("b").alias("class")).distinct()).distinct()
        found = stored(similar(close, candidate_sets(docs, both, like), like), "links")
        drop_stored(close, open_keys, *tables)
        links.append(found)
        tables = [lists]
        listed = lists.select("key", "class", "n")
        owner = components(reduce(DataFrame.unionByName, links), "a", "b").select(F.col("node").alias("class"), "root")
        if last:
            break
    return owner


def rows_of_components(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, mark, class, n and root (the class that names the component;
    null: an empty set, or a set that is alone) of every row of ``docs``, and
    beside the root lowest and class_id, the smallest doc_ids of component and class."""
    spark = docs.sparkSession
    prepare(spark)
    marks = stored(read_sets(docs, like), "sets")
    rows = marks.select("doc_id", "mark", "class", "n")
    sizes = rows.where(f"n >= {like.least}").agg(F.sum("n"), F.sum(F.floor(F.col("n") * (like.den - like.num) / like.den) + 1)).first()
    histogram = {r.n: r["count"] for r in rows.where(f"n between {like.least} and {4 * MAX_LIGHT}").groupBy("n").count().collect()}
    filters, companions = frequent(docs, sizes[0] or 0, like)
    x = boundary(histogram, companions, like)
    parts = max(partitions(spark), int((sizes[1] or 0) * 1.2) // PART_ROWS + 1)
    entries = stored(shared_entries(docs, filters, x, parts, like), "entries")
    bitmaps = stored(marks.where(f"n >= {like.least}").groupBy("class").agg(F.first("bits").alias("bits")), "bitmaps")
    owner = link_classes(entries, bitmaps, docs, like)
    drop_stored(entries, bitmaps)
    classes = (rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
               .join(owner, "class", "left"))
    classes = stored(classes.where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "class")), "classes")
    lowest = classes.groupBy("root").agg(F.min("class_id").alias("lowest"))
    known = (classes.join(lowest, "root").select("class", "class_id", "root", "lowest",
                                                 F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
            .join(known, ["class", "salt"], "left").drop("salt"))


def join(docs: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and
    class_id (smallest doc_id of an equal set) of every row of ``docs``."""
    return rows_of_components(docs, like).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id."""
    found = stored(rows_of_components(docs, like).where("root is not null").select("doc_id", "mark", "root"), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    rows = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times"))
    kept = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "mark", "times"), order).alias("row")).select("row.*")
    lost = (rows.select("doc_id", "mark").distinct()
            .join(kept.select(F.col("doc_id").alias("id"), F.col("mark").alias("of")),
                  F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left_anti"))
    doubled = kept.where("times > 1").select("doc_id", "mark")
    mark = fresh(docs.columns, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    gone = stored(lost.withColumn("once", F.lit(False)).unionByName(doubled.withColumn("once", F.lit(True)))
                  .select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "once"), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (marked[mark] == gone["gone_mark"])
    rest = marked.join(gone, same, "left_anti")
    if not gone.where("once").limit(1).count():
        return rest.drop(mark)
    once = marked.join(gone.where("once"), same, "left_semi").dropDuplicates(["doc_id", mark])
    return rest.unionByName(once).drop(mark)
