"""Operator 4 — byte-level BPE encoding and decoding by corpus-level merge replay.

Each task gathers the distinct pre-tokens of a stretch of its texts, lays their
bytes out in one array and replays the merges over all of them at once: an
inverted index from merge rank to the positions of the pairs it joins gives, in
rank order, exactly the places a merge applies to; only the neighbours of a
merged pair are looked at again. Texts are then assembled from the encoded
pre-tokens, so a pre-token is merged once per stretch however often it occurs.

Defined cases: null text encodes like the empty text (no ids); repeated rows
are encoded alike; texts of any length are encoded whole; columns other than
the text pass through, and the output columns get underscores where such a
column is there already; rank files with ranks beyond 17 bits are refused.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import arrow_map, fresh

STRETCH_CHARS = 2_000_000     # texts whose pre-tokens are merged together
STRETCH_DOCS = 20_000
KEPT_PIECES = 200_000         # encoded pieces a task keeps for later stretches
BLOCK = 1 << 16               # positions or pieces worked on at once where the order does not matter
NO_RANK = np.int32(1 << 20)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank of a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many byte strings together by replaying merges in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) > 0x1FFFF:
            raise ValueError("ranks beyond 17 bits")       # two of them make a key
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, vals = [], []
        for tok, rank in ranks.items():
            for cut in range(1, len(tok)):
                left, right = ranks.get(tok[:cut]), ranks.get(tok[cut:])
                if left is not None and right is not None:
                    keys.append(left << 17 | right)
                    vals.append(rank)
        self.keys, self.vals = np.array(keys, np.int64), np.array(vals, np.int32)
        self.levels = self._table(self.keys, self.vals)
        # ranks after which an earlier rank may become possible: one merge a word at a time
        back = (self.vals < (self.keys >> 17)) | (self.vals < (self.keys & 0x1FFFF))
        self.careful = set((self.keys[back] >> 17).tolist()) | set((self.keys[back] & 0x1FFFF).tolist())

    @staticmethod
    def _table(keys: np.ndarray, vals: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Hash tables of falling size; a key that finds its slot taken goes to
        the next one, and the slot remembers that."""
        levels, bits = [], max(12, len(keys).bit_length() + 2)
        while len(keys):
            slot = _slot(keys, bits)
            table_k, table_v = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK)
            table_k[slot], table_v[slot] = keys, vals
            left = table_k[slot] != keys
            more = np.zeros(1 << bits, bool)
            more[slot[left]] = True
            keys, vals = keys[left], vals[left]
            levels.append((bits, table_k, table_v, more))
            bits = max(12, bits - 3)
        return levels

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token each pair joins to; NO_RANK for none (or a missing side, -1)."""
        key = (left.astype(np.int64) << 17) | right   # a missing side makes it negative: never found
        bits, table_k, table_v, more = self.levels[0]
        slot = _slot(key, bits)
        miss = table_k[slot] != key
        out = table_v[slot]
        out[miss] = NO_RANK
        rest = np.flatnonzero(miss & more[slot])
        for bits, table_k, table_v, more in self.levels[1:]:
            if not len(rest):
                break
            sub = key[rest]
            slot = _slot(sub, bits)
            hit = table_k[slot] == sub
            out[rest[hit]] = table_v[slot[hit]]
            rest = rest[~hit & more[slot]]
        return out

    def _opens_earlier(self, r: int, before: np.ndarray, after: np.ndarray) -> bool:
        """Whether joining these pairs into ``r`` makes a pair of an earlier rank."""
        new = np.full(len(before), r)
        return bool((self._rank(before, new) < r).any() or (self._rank(new, after) < r).any()
                    or self._rank(new[:1], new[:1])[0] < r)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        kind = np.int32 if n < 0x7FFFFFFF else np.int64               # of positions
        word = np.repeat(np.arange(len(words), dtype=kind), lens)
        tok = self.byte_id[raw]
        if n == 0:
            return tok, lens
        nxt, prv = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        last = np.cumsum(lens)[lens > 0] - 1
        nxt[last] = n
        prv[np.append(0, last[:-1] + 1)] = n
        tok = np.append(tok, np.int32(-1))                     # slot n: no neighbour
        nxt, prv = np.append(nxt, kind(n)), np.append(prv, kind(n))
        now = np.full(n + 1, NO_RANK)                          # rank of the pair that starts at a position
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self._rank(tok[at], tok[nxt[at]])
            now[at] = rank
            keep = rank < NO_RANK
            enter(at[keep], rank[keep])

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            now[lo:hi] = self._rank(tok[lo:hi], tok[nxt[lo:hi]])
        at = np.flatnonzero(now < NO_RANK).astype(kind)
        enter(at, now[at])
        flag = np.zeros(n + 1, bool)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = _distinct(np.concatenate(parts) if len(parts) > 1 else parts[0])
            at = at[now[at] == r]                                 # still there
            if not len(at):
                continue
            rest = at[:0]
            if r in self.careful and self._opens_earlier(r, tok[prv[at]], tok[nxt[nxt[at]]]):
                _, one = np.unique(word[at], return_index=True)
                rest, at = np.delete(at, one), at[one]
            flag[at] = True
            if flag[prv[at]].any():                               # overlapping pairs: leftmost first
                keep, taken = [], -1
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(nxt[p])
                flag[at] = False
                at = np.array(keep, kind)
            else:
                flag[at] = False
            gone = nxt[at]
            after = nxt[gone]
            tok[at], tok[gone] = r, -1
            now[gone] = NO_RANK
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            note(np.concatenate([before[before < n], at]))
            if len(rest):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(rest)
        live = tok[:n] >= 0
        return tok[:n][live], np.bincount(word[live], minlength=len(words))


def _gather(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id runs of the entries ``at``, one after another, and where each ends."""
    ends = np.cumsum(counts[at])
    out = np.empty(int(ends[-1]) if len(ends) else 0, ids.dtype)
    done = 0
    for lo in range(0, len(at), BLOCK):
        some = at[lo:lo + BLOCK]
        reps, stop = counts[some], ends[lo:lo + BLOCK]
        step = np.arange(done, int(stop[-1])) - np.repeat(stop - reps, reps)
        out[done:int(stop[-1])] = ids[np.repeat(begins[some], reps) + step]
        done = int(stop[-1])
    return out, ends


class Encoder:
    """Encodes stretches of texts, keeping encoded pieces between stretches.

    A piece is what lies between single spaces, together with the space before
    it: the pattern never joins text across a space that has no other white
    space beside it, so a piece splits the same way wherever it stands. Texts
    with such neighbours are split whole.
    """

    def __init__(self, replay: MergeReplay, pattern: str):
        self.replay = replay
        self.split = regex.compile(pattern).findall
        self.uneven = re.compile(r"\s | \s").search
        self._forget()

    def _forget(self) -> None:
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.begins = self.counts = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.new: list[str] = []

    def _tidy(self) -> None:
        """Keep the pieces met more than once; when these are many, none."""
        keep = self.uses > 1
        if 2 * int(keep.sum()) > KEPT_PIECES:
            return self._forget()
        place = (np.cumsum(keep) - 1).tolist()
        kept = keep.tolist()
        self.spaced = {k: place[i] for k, i in self.spaced.items() if kept[i]}
        self.bare = {k: place[i] for k, i in self.bare.items() if kept[i]}
        self.ids, ends = _gather(self.ids, self.begins, self.counts, np.flatnonzero(keep))
        self.counts = self.counts[keep]
        self.begins = ends - self.counts
        self.uses = np.ones(len(ends), np.int64)

    def _piece(self, table: dict[str, int], key: str, text: str) -> int:
        at = table[key] = len(self.begins) + len(self.new)
        self.new.append(text)
        return at

    def _learn(self) -> None:
        """Encode the pieces met for the first time."""
        seen: dict[str, int] = {}
        at: list[int] = []
        stops = np.empty(len(self.new), np.int64)
        for i, piece in enumerate(self.new):
            for w in self.split(piece):
                at.append(seen.setdefault(w, len(seen)))
            stops[i] = len(at)
        ids, counts = self.replay.encode([w.encode() for w in seen])
        flat, ends = _gather(ids, np.cumsum(counts) - counts, counts, np.array(at, np.int64))
        lens = np.diff(np.append(0, np.append(0, ends)[stops]))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lens) - lens])
        self.counts = np.concatenate([self.counts, lens])
        self.ids = np.concatenate([self.ids, flat])
        self.new = []

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.begins) > KEPT_PIECES:
            self._tidy()
        at: list[int] = []
        stops = np.empty(len(texts) + 1, np.int64)
        stops[0] = 0
        known = self.spaced.get
        for i, t in enumerate(texts):
            if t and self.uneven(t):
                for w in self.split(t):
                    j = self.bare.get(w)
                    at.append(self._piece(self.bare, w, w) if j is None else j)
            elif t:
                first, *more = t.split(" ")
                j = self.bare.get(first)
                at.append(self._piece(self.bare, first, first) if j is None else j)
                for p in more:
                    j = known(p)
                    at.append(self._piece(self.spaced, p, " " + p) if j is None else j)
            stops[i + 1] = len(at)
        self._learn()
        where = np.array(at, np.int64)
        del at
        self.uses = np.bincount(where, minlength=len(self.begins)) + np.append(self.uses, np.zeros(len(self.begins) - len(self.uses), np.int64))
        out, ends = _gather(self.ids, self.begins, self.counts, where)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends)[stops].astype(np.int32)), pa.array(out))


class Vocabulary:
    """The bytes that lists of ids stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = pa.array(list(ranks), pa.binary())
        self.place = np.full(max(ranks.values()) + 1, -1, np.int32)
        self.place[list(ranks.values())] = np.arange(len(ranks))

    def __call__(self, ids: pa.Array) -> pa.Array:
        """One binary a list (null: empty); ids that the vocabulary lacks raise ``KeyError``."""
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
        flat = ids.flatten()
        if flat.null_count:
            raise KeyError(None)
        flat = flat.to_numpy(zero_copy_only=False)
        at = self.place[np.clip(flat, 0, len(self.place) - 1)]
        if (bad := flat[(at < 0) | (flat < 0) | (flat >= len(self.place))]).size:
            raise KeyError(int(bad[0]))
        if not len(at):
            return pa.array([b""] * len(ids), pa.binary())
        parts = self.tokens.take(pa.array(at))
        _, stops, data = parts.buffers()
        stops = np.frombuffer(stops, np.int32, len(at) + 1)[ends]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops), data])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``df`` with the text replaced by ``out_col`` array<int>, its token ids;
    with ``decoded_col`` also the bytes these stand for, as ``decode`` gives
    them, by the same workers: a second pass would double their number."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))    # one vocabulary file: fixed size
    rest = [c for c in df.columns if c != text_col]
    out_col = fresh(rest, out_col)
    more = [] if decoded_col is None else [fresh([*rest, out_col], decoded_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(MergeReplay(shared.value), pattern)
        decoded = Vocabulary(shared.value) if more else None

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = encoder([t for b in held for t in b.column(text_col).to_pylist()])
            at = 0
            for b in held:
                mine = ids.slice(at, b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in rest] + [mine] + [decoded(mine) for _ in more], names=[*rest, out_col, *more])
                at += b.num_rows

        held, chars, rows = [], 0, 0
        for b in batches:
            held.append(b)
            chars += b.column(text_col).nbytes
            rows += b.num_rows
            if chars >= STRETCH_CHARS or rows >= STRETCH_DOCS:
                yield from flush(held)
                held, chars, rows = [], 0, 0
        if held:
            yield from flush(held)

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest] + [f"`{out_col}` array<int>"] + [f"`{c}` binary" for c in more])
    return arrow_map(df.select(*rest, F.col(text_col)), run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` binary, the bytes its token ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names, out_col = df.columns, fresh(df.columns, out_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = Vocabulary(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decoded(b.column(ids_col))], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` binary"
    return arrow_map(df, run, schema)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = encode(docs.select("doc_id", "text"), ranks_path, pattern, decoded_col="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
