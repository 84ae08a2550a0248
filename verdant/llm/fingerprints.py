"""Operator 2 — one-permutation MinHash fingerprints.

Every 5-word shingle of a text is hashed once; the top bits of the hash name
its bin and the smallest hash of a bin stays. An empty bin takes the value of
the first filled bin in its own fixed random order of bins (optimal
densification). Each bin's value is mixed with the bin's number, so that copies
of one value agree with another text's by chance independently, and of the mix
only the lowest bits are stored, packed; the share of equal bins is corrected
for chance agreement (2**-bits).

Defined cases: a null text counts as the empty one; a text with fewer than
five words has one shingle (the whole sequence); a text without words has the
all-zero fingerprint, like 1 to another such text and 0 to any other; equal
texts have equal fingerprints. Words are lower-cased (A-Z) runs without white
space. Rows with a null id come first; rows with equal ids are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdant.llm.common import arrow_map, fresh, mix64, partitions, prepare, shingle_hashes

WIDTH, BIN_BITS, BITS = 5, 9, 4
BINS = 1 << BIN_BITS
FEW = 12                      # filled bins up to which ranks are compared outright

_rng = np.random.Generator(np.random.PCG64(20240607))
_ORDER = _rng.permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)   # bin -> bins in its order
_SALT = mix64(np.arange(1, BINS + 1, dtype=np.uint64) << np.uint64(20))
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)                                  # bin, bin -> place


def fingerprint_matrix(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of every bin (texts x BINS, uint8) and the words of each text."""
    hashes, counts, n_words = shingle_hashes(texts, WIDTH)
    n = len(counts)
    low = np.zeros((n, BINS), np.uint64)
    filled = np.zeros((n, BINS), bool)
    if len(hashes):
        bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        cell = np.repeat(np.arange(n), counts) * BINS + bins
        order = np.lexsort((hashes, cell))
        cell = cell[order]
        first = np.append(True, cell[1:] != cell[:-1])
        low.ravel()[cell[first]] = hashes[order][first]
        filled.ravel()[cell[first]] = True
    n_filled = filled.sum(axis=1)
    for d in np.flatnonzero((n_filled > 0) & (n_filled <= FEW)):
        have = np.flatnonzero(filled[d])
        kept = low[d, have]
        low[d] = low[d, have[np.argmin(_RANK[:, have], axis=1)]]
        low[d, have] = kept
    todo_d, todo_b = np.nonzero(~filled & (n_filled > FEW)[:, None])
    for k in range(BINS):
        if not len(todo_d):
            break
        source = _ORDER[todo_b, k]
        hit = filled[todo_d, source]
        low[todo_d[hit], todo_b[hit]] = low[todo_d[hit], source[hit]]
        todo_d, todo_b = todo_d[~hit], todo_b[~hit]
    bits = (mix64(low ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits[n_words == 0] = 0
    return bits, n_words


def pack(low: np.ndarray) -> list[str]:
    pairs = (low[:, 0::2] << 4) | low[:, 1::2]
    return [base64.b64encode(row.tobytes()).decode() for row in pairs]


def likeness(a: np.ndarray, words_a: np.ndarray, b: np.ndarray, words_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of paired rows, corrected for chance agreement."""
    chance = 2.0 ** -BITS
    same = (a == b).mean(axis=1)
    est = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where((words_a == 0) | (words_b == 0), ((words_a == 0) & (words_b == 0)).astype(float), est)


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with ``out_col`` (and underscores where it is there already): the
    packed fingerprint (base64) of every text."""
    names, out_col = df.columns, fresh(df.columns, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, _ = fingerprint_matrix(b.column(names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pack(low), pa.string())], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` string"
    return arrow_map(df, run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in ranges of ascending doc_id, each range followed by the
    first document of the next (the last by the very first): columns ``bucket``,
    ``guest``, ``key``, ``doc_id``, ``text``; every bucket lies sorted in one
    partition. The range bounds are ids that occur, found by Spark's quantile
    sketch; their number depends on the partitions, not on the data."""
    spark = docs.sparkSession
    prepare(spark)
    lowest = -(1 << 63)
    keyed = docs.select(F.coalesce("doc_id", F.lit(lowest)).alias("key"), "doc_id",
                        F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = 8 * n
    probs = ", ".join(str(i / cuts) for i in range(cuts))
    row = keyed.agg(F.min("key").alias("lo"), F.expr(f"percentile_approx(key, array({probs}), {10 * cuts})").alias("q")).first()
    if row.lo is None:
        bounds = np.array([lowest], np.int64)
    else:
        bounds = np.unique(np.array([row.lo, *row.q], np.int64))

    @pandas_udf("int")
    def bucket_of(key):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right") - 1).astype("int32")

    @pandas_udf("int")
    def host_of(key):
        import pandas as pd
        return pd.Series((np.searchsorted(bounds, key.to_numpy()) - 1) % len(bounds)).astype("int32")

    own = keyed.select(bucket_of("key").alias("bucket"), F.lit(False).alias("guest"), "key", "doc_id", "text")
    first = keyed.where(F.col("key").isin([int(x) for x in bounds]))
    guests = first.select(host_of("key").alias("bucket"), F.lit(True).alias("guest"), "key", "doc_id", "text")
    return own.unionByName(guests).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "key", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they
    are to each other and to the next document (see ``with_next``)."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, next text)."""
        edited = []
        for _, text, after in rows:
            half = len(text) // 2
            edited.append(text[:len(text) - half] + after[:half])
        ids = pa.array([r[0] for r in rows], pa.int64())
        own, own_n = fingerprint_matrix(pa.array([r[1] for r in rows], pa.large_string()))
        new, new_n = fingerprint_matrix(pa.array(edited, pa.large_string()))
        # a row's next text is mostly the following row's own
        follows = np.array([i + 1 < len(rows) and rows[i][2] is rows[i + 1][1] for i in range(len(rows))], bool)
        nxt, nxt_n = np.roll(own, -1, axis=0), np.roll(own_n, -1)
        alone = np.flatnonzero(~follows)
        if len(alone):
            nxt, nxt_n = nxt.copy(), nxt_n.copy()
            nxt[alone], nxt_n[alone] = fingerprint_matrix(pa.array([rows[i][2] for i in alone], pa.large_string()))
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(pack(own), pa.string()), pa.array(pack(new), pa.string()),
            pa.array(likeness(own, own_n, new, new_n)), pa.array(likeness(own, own_n, nxt, nxt_n))], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last, met_guest = None, None, False
        for b in batches:
            rows = []
            for k, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if k != bucket:
                    bucket, last, met_guest = k, None, False
                if met_guest:
                    continue                              # a copy of the guest
                if last is not None:
                    rows.append((*last, text))
                met_guest = guest
                last = (doc_id, text)
            for i in range(len(rows) - 1):                # the same object, so that finish() sees it
                if rows[i][2] == rows[i + 1][1]:
                    rows[i] = (*rows[i][:2], rows[i + 1][1])
            if rows:
                yield finish(rows)

    return arrow_map(with_next(docs), run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
