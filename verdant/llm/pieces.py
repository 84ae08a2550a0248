"""Operator 12 — SentencePiece encoding and decoding that keeps offsets.

A model file holds scored pieces and a compiled character map (a double-array
trie over byte sequences and the strings that replace them). A text is
normalised by the longest prefix the map knows at each place, and every
normalised character records the source byte it began at. Pieces are then
merged, highest score first, the leftmost of equals first; characters without a
piece fall back to their bytes. The lengths of the pieces, summed, give
positions in the normalised text, which the alignment projects to byte spans of
the original: the spans of a text follow each other, the byte pieces of one
character share its place (the last covers it, the ones before it are empty).

Merging never joins characters across a place where no piece of the model
could lie, so a text is cut there into chunks, and a task merges each chunk
once while it remembers it; models whose pieces lie across such places
(or that name symbols of their own) are merged over the whole text.

Defined cases: null and empty texts have no ids and decode to the empty text;
texts of any length are encoded whole (memory grows with one text, not with
the table); repeated rows are encoded alike; other columns pass through, and
output columns get underscores where such a column is there already. Ids that
decode to bytes that are no UTF-8 give U+FFFD for each such byte, unknown ids
raise ``ValueError``. Only models of merges (BPE) are read; others raise.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from verdant.llm.common import KeyTable, arrow_map, fresh

SPACE = "▁"              # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6        # kinds of pieces in model files
WIDTHS = (4, 6, 8, 12, 16, 24, 48)     # characters of chunks merged side by side; longer ones one by one
KEPT_CHUNKS = 400_000         # merged chunks a task remembers
_ID_BITS = 24                 # of an entry; above them the characters it covers
_ID = (1 << _ID_BITS) - 1
_SYMBOLS = 1 << 31
_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])       # of a text below 2 GB


# --- model file --------------------------------------------------------------

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at:at + size]
        at += size


class Model:
    """What a model file says: pieces with score and kind, and how texts are normalised."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model's pieces are not learned by merging pairs (BPE)")
        self.suffix = bool(trainer.get(24, 0))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.unknown = self.kinds.index(UNKNOWN)
        self.char_map: bytes = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.own = [p for p, k in zip(self.pieces, self.kinds) if k == OWN]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


# --- normalisation -----------------------------------------------------------

class CharMap:
    """The compiled character map: a double-array trie and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and replacement of the longest key that ``data`` has at ``at``."""
        units = self.units
        if not units:
            return None
        best = None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1]:end]


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """Normalised text and, for each of its characters and its end, the source byte."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharMap(model.char_map)
        self.own = re.compile("|".join(map(re.escape, sorted(model.own, key=len, reverse=True))).encode()) if model.own else None
        self.space = SPACE if model.escape else " "
        self.plain = not self.map.units and not self.own and not model.trim and not model.suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.plain:
            return self._by_prefix(raw)
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        lead = [0] if self.model.dummy_prefix else []
        out = (self.space if lead else "") + (text.replace(" ", SPACE) if self.model.escape else text)
        return out, np.concatenate([np.array(lead, np.int64), starts, [len(raw)]])

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        if self.own and (m := self.own.match(raw, at)):
            return m.end() - at, m.group()
        found = self.map.longest(raw, at)
        if found:
            return found
        n = _width(raw[at])
        return n, raw[at:at + n]

    def _by_prefix(self, raw: bytes) -> tuple[str, np.ndarray]:
        model, space = self.model, self.space
        at, out, align = 0, [], []
        if model.trim:
            while at < len(raw):
                n, new = self._step(raw, at)
                if new != b" ":
                    break
                at += n
        if at == len(raw):
            return "", np.full(1, at, np.int64)
        if model.dummy_prefix and not model.suffix:
            out.append(space)
            align.append(at)
        after_space = model.trim
        while at < len(raw):
            n, new = self._step(raw, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                for c in new.decode():
                    out.append(space if c == " " else c)
                    align.append(at)
                after_space = model.trim and new.endswith(b" ")
            at += n
        if model.trim:
            while out and out[-1] == space:
                out.pop()
                at = align.pop()
        if model.dummy_prefix and model.suffix:
            out.append(space)
            align.append(at)
        return "".join(out), np.array([*align, at], np.int64)


# --- merging -----------------------------------------------------------------

class Merger:
    """Normalised text → entries: a piece's id, and above it the characters it covers."""

    def __init__(self, model: Model):
        self.model = model
        kept = [(p, s) for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (NORMAL, OWN, UNUSED)]
        level = {s: i for i, s in enumerate(sorted({s for _, s in kept}, reverse=True))}
        self.rank = {p: level[s] for p, s in kept if len(p) > 1}        # equal scores are one rank
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, OWN, UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unused = {p for p, k in zip(model.pieces, model.kinds) if k == UNUSED}
        self.own = re.compile("|".join(map(re.escape, sorted(model.own, key=len, reverse=True)))) if model.own else None
        across = re.compile(f"[^{SPACE}]{SPACE}").search
        linked = sorted(set("".join(self.rank)) - {SPACE})
        self.cut = None
        if not model.own and linked and not any(map(across, self.rank)):
            letters = "[" + "".join(map(re.escape, linked)) + "]"
            other = "[^" + "".join(map(re.escape, linked)) + SPACE + "]"
            self.cut = re.compile(f"{SPACE}*{letters}+|{SPACE}+|{other}", re.DOTALL).findall
            if not self.unused:
                self._tables(linked)
            else:
                self.cut = None
        self._forget()

    def _tables(self, linked: list[str]) -> None:
        """Symbols are the characters that pieces link, the pieces, and beyond
        them all characters; pairs of symbols that make a piece, by key."""
        number = {c: i for i, c in enumerate(dict.fromkeys([*linked, SPACE, *self.rank]))}
        self.linked, self.none = len(number), len(self.id)
        pairs = sorted((number[p[:k]] * _SYMBOLS + number[p[k:]], r, number[p]) for p, r in self.rank.items()
                       for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.table = KeyTable(np.array([k for k, _, _ in pairs], np.int64))
        self.ranks = np.array([r for _, r, _ in pairs] + [self.none], np.int32)     # the last for pairs that make none
        self.made = np.array([m for _, _, m in pairs], np.int32)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(self.linked)
        self.symbol_of[[ord(c) for c in (*linked, SPACE)]] = [number[c] for c in (*linked, SPACE)]
        self.point_of = np.array([ord(p) if len(p) == 1 else 0 for p in number], np.int64)
        self.entry_of = np.array([self.id[p] | len(p) << _ID_BITS if p in self.id else -1 for p in number] + [-1], np.int64)
        self.entry_of_char = np.full(0x110000, -1, np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.entry_of_char[ord(p)] = i | 1 << _ID_BITS

    def _merge_long(self, parts: list[str], frozen: list[bool], halves: dict | None) -> list[str]:
        n = len(parts)
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, str]] = []

        def note(i: int, j: int) -> None:
            if not frozen[i] and not frozen[j]:
                r = rank(parts[i] + parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            note(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or not parts[i] or parts[i] + parts[j] != both:
                continue
            if halves is not None:
                halves.setdefault(both, (parts[i], parts[j]))
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                note(i, after[i])
            if before[i] >= 0:
                note(before[i], i)
        return [p for p in parts if p]

    def _entry(self, piece: str, halves: dict | None, out: list[int]) -> None:
        if halves and piece in self.unused and piece in halves:
            for half in halves[piece]:
                self._entry(half, halves, out)
            return
        at = self.id.get(piece, self.model.unknown)
        if at == self.model.unknown and self.model.byte_fallback:
            out += [self.byte_id[b] for b in piece.encode()]
            out[-1] |= len(piece) << _ID_BITS
        else:
            out.append(at | len(piece) << _ID_BITS)

    def merge(self, chunk: str) -> list[int]:
        """The entries of one chunk of any length, by a queue of pairs."""
        halves = {} if self.unused else None
        parts, frozen, at = [], [], 0
        for m in self.own.finditer(chunk) if self.own else ():
            parts += [*chunk[at:m.start()], m.group()]
            frozen += [False] * (m.start() - at) + [True]
            at = m.end()
        parts += chunk[at:]
        frozen += [False] * (len(chunk) - at)
        out: list[int] = []
        for p in self._merge_long(parts, frozen, halves):
            self._entry(p, halves, out)
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` without) and place in the pair table of symbols side by side."""
        at = self.table.find(np.where(right < 0, -2, left.astype(np.int64) * _SYMBOLS + right))
        return self.ranks[at], at

    def _merge_rows(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every chunk of at most ``width`` characters, in one
        array, and their number: a row a chunk, one merge a row at a time.
        Merged symbols leave holes that the neighbours' links step over; the
        last column stands for no neighbour."""
        n = len(chunks)
        lens = np.fromiter(map(len, chunks), np.int64, n)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        final = np.full((n, width + 1), -1, np.int32)
        column = np.arange(width + 1, dtype=np.int32)
        final[column < lens[:, None]] = self.symbol_of[points]
        rows, sym = np.arange(n), final
        after = np.where(column + 1 < lens[:, None], column + 1, width)
        before = np.tile(np.append(width, column[:-1]), (n, 1))
        rank = np.full((n, width + 1), self.none, np.int32)
        rank[:, :-1] = self._pair(sym[:, :-1], sym[:, 1:])[0]
        while True:
            at = rank.argmin(axis=1)                                         # the leftmost of equals
            line = np.flatnonzero(rank[np.arange(len(rank)), at] < self.none)
            if 2 * len(line) < len(rank):
                final[rows] = sym
                rows, sym, rank, after, before, at = rows[line], sym[line], rank[line], after[line], before[line], at[line]
                line = np.arange(len(rows))
            if not len(line):
                break
            at = at[line]
            right = after[line, at]
            made = self.made[self._pair(sym[line, at], sym[line, right])[1]]
            beyond, ahead = after[line, right], before[line, at]
            sym[line, at], sym[line, right], rank[line, right] = made, -1, self.none
            after[line, at], before[line, beyond] = beyond, at
            rank[line, at] = self._pair(made, sym[line, beyond])[0]
            rank[line, ahead] = self._pair(sym[line, ahead], made)[0]
            rank[line[ahead == width], width] = self.none
        there = final >= 0
        return final[there].astype(np.int64), there.sum(axis=1)

    def _entries(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of symbols; characters without a piece become their bytes."""
        out = self.entry_of[np.minimum(symbols, self.linked)]
        single = np.flatnonzero(symbols >= self.linked)
        points = symbols[single] - self.linked
        out[single] = self.entry_of_char[points]
        strange = np.flatnonzero(out < 0)
        if not len(strange):
            return out, counts
        left = symbols[strange]
        chars, which = np.unique(np.where(left >= self.linked, left - self.linked, self.point_of[np.minimum(left, self.linked - 1)]),
                                 return_inverse=True)
        spelled = [np.array(self._spell(chr(c)), np.int64) for c in chars.tolist()]
        times = np.ones(len(out), np.int64)
        times[strange] = np.array([len(x) for x in spelled])[which]
        ends = np.cumsum(times)
        wide = np.repeat(out, times)
        for k, x in enumerate(spelled):
            begin = (ends - times)[strange[which == k]]
            wide[begin[:, None] + np.arange(len(x))] = x
        word_ends = np.append(0, ends)[np.cumsum(counts)]
        return wide, np.diff(np.append(0, word_ends))

    def _spell(self, char: str) -> list[int]:
        out: list[int] = []
        self._entry(char, None, out)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Merge chunks met for the first time; ``known`` says where their entries are."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        low = 0
        for width in WIDTHS:
            some = [chunks[i] for i in np.flatnonzero((lens > low) & (lens <= width)).tolist()]
            low = width
            for k in range(0, len(some), 20_000):
                part = some[k:k + 20_000]
                self._keep(part, *self._entries(*self._merge_rows(part, width)))
        long = [chunks[i] for i in np.flatnonzero(lens > low).tolist()]
        if long:
            found = [self.merge(c) for c in long]
            self._keep(long, np.array([e for f in found for e in f], np.int64), np.array([len(f) for f in found]))

    def _keep(self, chunks: list[str], entries: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.counts)
        self.known.update(zip(chunks, range(at, at + len(chunks))))
        self.begins = np.append(self.begins, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.flat = np.append(self.flat, entries)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = self.begins = self.counts = np.empty(0, np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is None:
            out = [np.array(self.merge(t), np.int64) for t in texts]
        else:
            cut = [self.cut(t) for t in texts]
            chunks = list(chain.from_iterable(cut))
            new = set(chunks).difference(self.known)
            if len(self.known) + len(new) > KEPT_CHUNKS:
                self._forget()
                new = set(chunks)
            self._learn(list(new))
            at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
            reps = self.counts[at]
            ends = np.cumsum(reps)
            step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - reps, reps)
            entries = self.flat[np.repeat(self.begins[at], reps) + step]
            out = np.split(entries, np.append(0, ends)[np.cumsum([len(c) for c in cut])][:-1]) if cut else []
        return out if self.model.byte_fallback else [self._one_unknown(e) for e in out]

    def _one_unknown(self, entries: np.ndarray) -> np.ndarray:
        """Neighbouring unknown characters are one piece."""
        if not len(entries):
            return entries
        strange = entries & _ID == self.model.unknown
        first = ~strange | ~np.append(False, strange[:-1])
        lens = np.add.reduceat(entries >> _ID_BITS, np.flatnonzero(first))
        return (entries[first] & _ID) | lens << _ID_BITS


def encode_texts(normalise: Normaliser, merge: Merger, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text its ids and, one longer, the source bytes at which the
    pieces begin and the last ends."""
    flat = [normalise(t or "") for t in texts]
    return [(e & _ID, align[np.append(0, np.cumsum(e >> _ID_BITS))]) for e, (_, align) in zip(merge([f for f, _ in flat]), flat)]


# --- decoding ----------------------------------------------------------------

class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
                      for p, k in zip(model.pieces, model.kinds)]
        self.simple = np.array([k in (NORMAL, OWN, UNUSED, BYTE) for k in model.kinds])
        self.spaced = np.array([k != BYTE and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds)])

    def __call__(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.bytes):
            raise ValueError("an id beyond the model's pieces")
        if self.simple[ids].all() and not self.model.trim:
            data = b"".join([self.bytes[i] for i in ids.tolist()])
            if self.spaced[ids[0]] and self.model.dummy_prefix:
                data = data[1:]
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        return self._one_by_one(ids.tolist())

    def _one_by_one(self, ids: list[int]) -> str:
        model, out, held, seen = self.model, [], b"", False
        filled = False

        def flush() -> None:
            nonlocal held, filled
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[at:at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
                filled = True
            held = b""

        for i in ids:
            kind, piece = model.kinds[i], model.pieces[i]
            if kind == BYTE:
                held += self.bytes[i]
                continue
            flush()
            at_start = not seen and not filled
            seen = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                piece = model.unknown_text
            else:
                if at_start and (model.dummy_prefix or model.trim) and piece.startswith(SPACE):
                    piece = piece[1:]
                    seen = not model.trim
                piece = piece.replace(SPACE, " ")
            out.append(piece)
            filled = filled or bool(piece)
        flush()
        return "".join(out)


# --- tables ------------------------------------------------------------------

def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", spans_col: str = "spans",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the text replaced by its token ids (array<int>) and the byte
    span (begin, end) of each in the UTF-8 text; with ``decoded_col`` also the
    text the ids stand for, as ``decode`` gives it, by the same workers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))       # one file: fixed size
    rest = [c for c in docs.columns if c != text_col]
    ids_col = fresh(rest, ids_col)
    spans_col = fresh([*rest, ids_col], spans_col)
    more = [] if decoded_col is None else [fresh([*rest, ids_col, spans_col], decoded_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        normalise, merge = Normaliser(model), Merger(model)
        text = Decoder(model) if more else None
        for b in batches:
            found = encode_texts(normalise, merge, b.column(len(rest)).to_pylist())
            ids = _lists([i.astype(np.int32) for i, _ in found], pa.int32())
            begins = _lists([s[:-1].astype(np.int32) for _, s in found], pa.int32())
            ends = _lists([s[1:].astype(np.int32) for _, s in found], pa.int32())
            spans = pa.ListArray.from_arrays(begins.offsets, pa.StructArray.from_arrays([begins.values, ends.values], ["begin", "end"]))
            back = [pa.array([text(i) for i, _ in found], pa.string()) for _ in more]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, spans, *back], names=[*rest, ids_col, spans_col, *more])

    return arrow_map(docs.select(*[f"`{c}`" for c in rest], F.col(text_col)), run,
                     StructType([*(docs.schema[c] for c in rest), StructField(ids_col, ArrayType(IntegerType())),
                                 StructField(spans_col, ArrayType(_SPAN)), *(StructField(c, StringType()) for c in more)]))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the text its token ids stand for (null ids: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    place, names = df.columns.index(ids_col), [*df.columns, fresh(df.columns, out_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Decoder(Model(shared.value))
        for b in batches:
            out = [text(np.array(x or (), np.int64)) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=names)

    return arrow_map(df, run, StructType([*df.schema.fields, StructField(names[-1], StringType())]))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (where the last span ends; 0 without)."""
    out = encode(docs.select("doc_id", "text"), model_path, decoded_col="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("spans", F.size("spans") - 1)["end"].cast("bigint"), F.lit(0)).alias("covered_bytes"))
