"""Helpers shared by the operators: scratch tables, Arrow passes, word and
shingle hashing over whole Arrow batches, fixed-size bit filters and connected
components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.session import checkpoint_dir, ship_package

BATCH_ROWS = 512              # rows of one Arrow batch,
BATCH_BYTES = 1 << 20         # which is also closed beyond so many bytes: texts may be long


def prepare(spark: SparkSession) -> None:
    """Session settings every operator with an Arrow pass relies on: small
    batches (bounded Python memory whatever the text length) and the package
    on the executors' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again:
    lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column clashes."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                 # another C library
        pass


# --- word and shingle hashing ------------------------------------------------

_U = np.uint64
_SEED = 0x9E3779B97F4A7C15
_POWERS = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_SEED))
    _POW = np.cumprod(np.full(_POWERS, 0xD6E8FEB86659FD93, dtype=np.uint64))
    _PLACE = mix64(np.arange(11, 43, dtype=np.uint64) * _U(_SEED)) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts, and where each begins and the last ends."""
    texts = pa.concat_arrays([texts]) if not isinstance(texts, pa.ChunkedArray) else texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    if n == 0 or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def word_hashes(texts: pa.Array, separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()):
    """64-bit hashes of the words of every text, A-Z lower-cased, and the
    number of words per text (null: none); for every length in ``prefixes``
    also the hashes of the words' first bytes, shorter words being 0. Words are the runs between
    separators, by default ``[^\\x20\\x09-\\x0D]+``. Works on the UTF-8 bytes of
    the whole batch at once: separators are ASCII, so they never fall inside a
    character."""
    raw, off = utf8(texts)
    n = len(off) - 1
    if not len(raw):
        return (np.empty(0, np.uint64), np.zeros(n, np.int64), *[np.empty(0, np.uint64)] * len(prefixes))
    solid = ~separators[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = off[:-1][(off[:-1] < len(raw)) & (off[:-1] < off[1:])]
    first[edges] = solid[edges]                       # a text's first byte starts a word
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, off))
    if len(starts) == 0:
        return (np.empty(0, np.uint64), counts, *[np.empty(0, np.uint64)] * len(prefixes))
    at = np.flatnonzero(solid)
    begin = np.searchsorted(at, starts)
    lens = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lens)
    with np.errstate(over="ignore"):
        power = _POW[place & (_POWERS - 1)]
        if lens.max() > _POWERS:                      # powers of longer words, a stretch of _POWERS bytes further each
            power = power * np.append(_U(1), np.cumprod(np.full(int(lens.max()) // _POWERS, _POW[-1], np.uint64)))[place // _POWERS]
        value = _BYTE[_LOWER[raw[at]]] * power
        words = mix64(np.add.reduceat(value, begin) ^ (lens.astype(np.uint64) * _U(_SEED)))
        heads = []
        for k in prefixes:
            total = np.add.reduceat(np.where(place < k, value, _U(0)), begin)
            heads.append(np.where(lens >= k, mix64(total ^ _U(k << 48)), _U(0)))
        return (words, counts, *heads)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word shingles of every text in order, shingles per text
    and words per text. With fewer than ``width`` words the whole sequence is
    one shingle; without words there is none."""
    words, n_words = word_hashes(texts)
    ends = np.cumsum(n_words)
    begins = ends - n_words
    with np.errstate(over="ignore"):
        if len(words) >= width:
            total = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                total += words[k:len(words) - width + 1 + k] * _PLACE[k]
            rolled = mix64(total)
        else:
            rolled = np.empty(0, np.uint64)
        counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        out = np.empty(int(counts.sum()), np.uint64)
        to = np.cumsum(counts) - counts
        whole = n_words >= width
        if whole.any():
            reps = counts[whole]
            step = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            out[np.repeat(to[whole], reps) + step] = rolled[np.repeat(begins[whole], reps) + step]
        for i in np.flatnonzero(~whole & (n_words > 0)):
            seq = words[begins[i]:ends[i]]
            total = (seq * _PLACE[:len(seq)]).sum(dtype=np.uint64)
            out[to[i]] = mix64(np.array([total + _U(len(seq)) * _U(_SEED)], np.uint64))[0]
    return out, counts, n_words


class KeyTable:
    """Place of int64 keys in the array they came in, by hashing. A key that
    finds its slot taken goes to a smaller table, and the slot remembers that."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        at, bits = np.arange(len(keys)), max(10, int(len(keys)).bit_length() + 2)
        while len(keys) or not self.levels:
            slot = self._slot(keys, bits)
            held, place, more = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)
            held[slot], place[slot] = keys, at
            left = held[slot] != keys
            more[slot[left]] = True
            keys, at = keys[left], at[left]
            self.levels.append((bits, held, place, more))
            bits = max(8, bits - 2)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(_U) * _U(_SEED)) >> _U(64 - bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` (none negative but for those that are nowhere), -1 without."""
        keys = np.ascontiguousarray(keys)
        bits, held, place, more = self.levels[0]
        slot = self._slot(keys, bits)
        hit = held[slot] == keys
        out = np.where(hit, place[slot], -1)
        rest = np.flatnonzero((~hit & more[slot]).ravel())
        for bits, held, place, more in self.levels[1:]:
            if not len(rest):
                break
            some = keys.ravel()[rest]
            slot = self._slot(some, bits)
            hit = held[slot] == some
            out.ravel()[rest[hit]] = place[slot[hit]]
            rest = rest[~hit & more[slot]]
        return out


# --- fixed-size bit filter ---------------------------------------------------

FILTER_BITS = 1 << 26     # 8 MB whatever the data; more members only raise false hits


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """One-hash Bloom filter of a bigint hash column as 2**20 64-bit words.
    The words are OR-ed by Spark with map-side combining; what reaches the
    driver is bounded by FILTER_BITS."""
    slot = F.shiftrightunsigned(F.col(column), 38)                     # top 26 bits
    words = hashes.select(F.shiftright(slot, 6).alias("w"),
                          F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                          slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    rows = (words.groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
            .groupBy(F.shiftright("w", 13).alias("block"))
            .agg(F.collect_list("w").alias("ws"), F.collect_list("b").alias("bs")).collect())
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in rows:
        out[np.array(r.ws, np.int64)] = np.array(r.bs, np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> _U(38)
    return (bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) != 0


# --- connected components ----------------------------------------------------

def components(links: DataFrame, a: str, b: str, tag: str = "components") -> DataFrame:
    """Smallest id reachable from every id that occurs in ``links``: columns
    ``node``, ``root``. Alternating large-star / small-star rounds; each round
    is two aggregations over the links, which never outgrow the input, and the
    number of rounds is logarithmic in the longest chain."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where("u <> v").distinct(), tag)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())
        after = stored(small, tag)
        size, change = edges.count(), after.exceptAll(edges).limit(1).count()
        if change == 0 and after.count() == size:
            break
        edges = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
