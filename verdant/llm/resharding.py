"""Operator 6 — minimum-cost-flow resharding.

Old shards are cut into hash blocks. A flow network carries every block's rows
to the new shards: staying costs nothing, leaving costs the block's bytes a
row, and each new shard takes exactly its capacity. The cheapest flow
(successive shortest paths; its size depends on shards and blocks, not on the
data) says how many rows of which block go where. Rows are numbered inside
their block while the old files are written, a number for each writing task and
block, and the flow's intervals are read off that numbering, so that no text is
shuffled. Every shard that loses or gains rows is written anew, whole, in one
folder; only shards that do neither keep their old files.

Law ``rows``: the shards' row counts are at most one apart. Defined cases: a
null text has no bytes (size 1) and the checksum of the empty text; a null id
hashes like the empty string; repeated rows are separate rows; an empty table
gives empty shards; other columns travel with the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm.common import arrow_map, fresh, scratch, stored

BLOCKS = 16                   # blocks of an old shard


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a cheapest maximum flow."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in edges:
        for a, b, room, price in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(room)
            cost.append(price)
    height = [0] * n
    while True:
        dist, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e] and (new := d + cost[e] + height[u] - height[to[e]]) < dist.get(to[e], new + 1):
                    dist[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if sink not in dist:
            return [cap[2 * i + 1] for i in range(len(edges))]
        for u in range(n):
            height[u] += dist.get(u, dist[sink])
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room


@dataclass
class Move:
    """Rows ``lo`` to ``hi`` of a block (numbered from 0) become slots of a shard."""
    old: int
    block: int
    lo: int
    hi: int
    shard: int
    slot: int


def plan(blocks: list[tuple[int, int, int, int]], capacities: list[int]) -> list[Move]:
    """blocks: (old shard, block, rows, bytes). The cheapest transfers that fill
    every capacity (which must add up to the rows)."""
    n_new = len(capacities)
    source, sink, pool = 0, 1, 2
    shard = [3 + j for j in range(n_new)]
    edges = []
    for b, (old, _, rows, size) in enumerate(blocks):
        node = 3 + n_new + b
        edges.append((source, node, rows, 0))
        edges.append((node, shard[old] if old < n_new else pool, rows, 0 if old < n_new else size * 1000 // rows))
        edges.append((node, pool, rows if old < n_new else 0, size * 1000 // rows))
    for j, c in enumerate(capacities):
        edges.append((pool, shard[j], c, 0))
        edges.append((shard[j], sink, c, 0))
    flow = min_cost_flow(3 + n_new + len(blocks), edges, source, sink)
    free = [0] * n_new                                  # next free slot of each shard
    moves, leaving = [], []
    for b, (old, block, rows, _) in enumerate(blocks):  # who stays keeps the first slots
        stay = flow[3 * b + 1] if old < n_new else 0
        if stay:
            moves.append(Move(old, block, 0, stay, old, free[old]))
            free[old] += stay
        if stay < rows:
            leaving.append([old, block, stay, rows])
    for j in range(n_new):
        while free[j] < capacities[j]:
            part = leaving[-1]
            take = min(part[3] - part[2], capacities[j] - free[j])
            moves.append(Move(part[0], part[1], part[2], part[2] + take, j, free[j]))
            free[j] += take
            part[2] += take
            if part[2] == part[3]:
                leaving.pop()
    return moves


def numbered(rows: DataFrame, shard: str, block: str, at: str, n_old: int) -> DataFrame:
    """``rows`` and their number ``at`` among those of their task, shard and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(n_old * BLOCKS, np.int64)
        for b in batches:
            key = b.column(shard).to_numpy().astype(np.int64) * BLOCKS + b.column(block).to_numpy()
            kinds, counts = np.unique(key, return_counts=True)
            place = np.empty(len(key), np.int64)
            place[np.argsort(key, kind="stable")] = np.arange(len(key)) + np.repeat(met[kinds] - np.cumsum(counts) + counts, counts)
            met[kinds] += counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, at])

    return arrow_map(rows, run, T.StructType([*rows.schema.fields, T.StructField(at, T.LongType())]))


@dataclass
class Layout:
    """``placed``: uid, doc_id, size, text_crc32, old_shard, shard, slot of every
    row. ``before``: folder of the old files, ``old_shard=`` by shard. ``after``:
    folder of the shards written anew, ``shard=`` by shard, those that stayed
    and those that arrived in files of their own (``arrived=``). ``rows``: all
    rows of the new shards with shard and slot, read from the shards' files: those
    of ``after`` and, for the shards ``untouched``, those of ``before``. ``shard``,
    ``slot`` and ``arrived`` name these columns: with underscores where the table
    has such columns of its own."""
    placed: DataFrame
    before: str
    after: str
    untouched: list[int]
    rows: DataFrame
    shard: str = "shard"
    slot: str = "slot"
    arrived: str = "arrived"


def lay_out(docs: DataFrame, n_old: int, n_new: int) -> Layout:
    """Lay ``docs`` (doc_id, text and others) out in ``n_old`` hash shards, then
    rewrite these as ``n_new``."""
    spark = docs.sparkSession
    uid, size, crc, block, run, at, shard_of, shard, slot, arrived = (fresh(docs.columns, c) for c in (
        "uid", "size", "text_crc32", "block", "run", "at", "old_shard", "shard", "slot", "arrived"))
    before, after = scratch(spark, "shards-old"), scratch(spark, "shards-new")
    text = F.coalesce("text", F.lit(""))
    cut = docs.withColumns({
        uid: F.monotonically_increasing_id(),
        size: F.octet_length(text).cast("bigint") + 1, crc: F.crc32(text.cast("binary")),
        shard_of: F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                         F.lit(n_old)).cast("int")})
    cut = cut.withColumns({run: F.shiftright(uid, 33),                     # the writing task
                           block: F.pmod(F.xxhash64(uid), F.lit(BLOCKS)).cast("int")})
    cut = numbered(cut, shard_of, block, at, n_old)
    cut.write.partitionBy(shard_of).parquet(before)
    old = spark.read.schema(cut.schema).parquet(before)
    runs = stored(old.groupBy(shard_of, block, run).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
                  .withColumn("start", F.sum("n").over(W.partitionBy(shard_of, block).orderBy(run)) - F.col("n")), "runs")
    blocks = [tuple(r) for r in runs.groupBy(shard_of, block)
              .agg(F.sum("n"), F.sum("bytes")).orderBy(shard_of, block).collect()]
    total = sum(b[2] for b in blocks)
    moves = plan(blocks, [total // n_new + (j < total % n_new) for j in range(n_new)])
    pieces = F.broadcast(spark.createDataFrame(          # at most blocks + shards rows
        [(m.old, m.block, m.lo, m.hi, m.shard, m.slot) for m in moves],
        "old int, piece_of int, lo bigint, hi bigint, shard int, base bigint"))
    starts = runs.select(F.col(shard_of).alias("old"), F.col(block).alias("piece_of"), F.col(run).alias("by"), "start")
    changed = {s for m in moves if m.old != m.shard for s in (m.old, m.shard)}
    untouched = sorted({m.old for m in moves} - changed)

    def located(rows: DataFrame, *columns, names: tuple[str, str] = (shard, slot)) -> DataFrame:
        """``columns`` of old rows, their shard and slot."""
        o, s, p = rows.alias("o"), starts.alias("s"), pieces.alias("p")
        nth = F.col(f"o.{at}") + F.col("s.start")
        return (o.join(s, (F.col(f"o.{shard_of}") == F.col("s.old")) & (F.col(f"o.{block}") == F.col("s.piece_of"))
                       & (F.col(f"o.{run}") == F.col("s.by")))
                .join(p, (F.col(f"o.{shard_of}") == F.col("p.old")) & (F.col(f"o.{block}") == F.col("p.piece_of"))
                      & (nth >= F.col("p.lo")) & (nth < F.col("p.hi")))
                .select(*columns, F.col("p.shard").alias(names[0]), (F.col("p.base") + nth - F.col("p.lo")).alias(names[1])))

    given = [F.col(f"o.`{c}`") for c in docs.columns]
    stays = F.col(shard_of).isin(untouched)
    anew = located(old.where(~stays), *given, F.col(f"o.{shard_of}").alias(shard_of))
    anew = anew.withColumn(arrived, (F.col(shard) != F.col(shard_of)).cast("int")).drop(shard_of)
    anew.write.partitionBy(shard, arrived).parquet(after)
    rows = spark.read.schema(anew.schema).parquet(after).drop(arrived)
    if untouched:
        rows = rows.unionByName(located(old.where(stays), *given))
    placed = located(old, F.col(f"o.{uid}").alias("uid"), "o.doc_id", F.col(f"o.{size}").alias("size"),
                     F.col(f"o.{crc}").alias("text_crc32"), F.col(f"o.{shard_of}").alias("old_shard"), names=("shard", "slot"))
    return Layout(placed, before, after, untouched, rows, shard, slot, arrived)


def reshard(docs: DataFrame, n_old: int, n_new: int) -> tuple[DataFrame, str, str]:
    """The placement (uid, doc_id, size, text_crc32, old_shard, shard, slot) of
    ``lay_out``, the folder of its old files and the path of those files of the
    new shards that hold the rows which changed shard."""
    new = lay_out(docs, n_old, n_new)
    return new.placed, new.before, f"{new.after}/{new.shard}=*/{new.arrived}=1"


def digest(docs: DataFrame, n_old: int = 12, n_new: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, as
    read back from the files of the new shards."""
    text = F.coalesce("text", F.lit(""))
    return lay_out(docs.select("doc_id", "text"), n_old, n_new).rows.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
