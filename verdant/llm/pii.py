"""Operator 1 — personal data by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. The
random field looks at the tokens (runs without white space) that hold a digit
or ``@``: a chain links tokens that stand side by side, and skip links join
distant tokens of a document that repeat the same digits or address, or end in
the same ones. Tokens in base spans have their label, tokens in matches that
failed their check (Luhn, octets, digits) and plain words have none; for the
rest loopy message passing finds the label marginals, so that a number written
without its prefix takes the label of its full form elsewhere. Sure tokens
become further spans beside the base ones.

Potentials are trained piecewise: Spark counts labels by token shape (in
``SHAPE_BUCKETS`` hash cells, so that the table has one size whatever the
corpus; shapes of one cell share a potential), by chain link and by skip link
over all documents; a potential is the logarithm of how far the counts go
beyond chance.

Defined cases: a null text is the empty text; repeated rows are treated alike;
a document with no candidate token keeps its base spans; overlapping spans of
several kinds are masked together under the first; other columns pass through
``mask``. Offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import arrow_map, fresh

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SURE = 0.9                    # marginal beyond which a token becomes a span
ROUNDS, DAMPING = 20, 0.3
SHAPE_BUCKETS = 1 << 16       # hash cells that shapes are counted in: all are, however many there are
MIN_SHAPE = 5                 # labelled tokens behind a cell's potential
UNSEEN = 2.0                  # what a shape no pattern ever matched loses against "none"
SAME = 100                    # links between equal labels assumed before any is counted

# The base patterns. Possessive parts and the look-behind only
# spare retries that cannot succeed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]\S*")
_DIGITS = re.compile(r"[^0-9]+")
_PART = re.compile(r"[+(]?[0-9][0-9().-]*")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of all base matches, and the matches that failed their check."""
    found, failed, last = [], [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            found.append((0, at, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
        else:
            failed.append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19:
                if luhn(digits):
                    found.append((2, *m.span()))
                else:
                    failed.append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append((3, *m.span()))
        else:
            failed.append(m.span())
    return found, failed


@dataclass
class Tokens:
    """The candidate tokens of a text: place, label (-1: open), shape, whether
    the next token stands beside it, and the keys it shares with others."""
    span: list[tuple[int, int]]
    label: list[int]
    shape: list[str]
    beside: list[bool]
    keys: list[list[str]]


def shape_of(token: str) -> str:
    """Letters become ``a``, digits ``d`` and their number; the rest stays."""
    mark = lambda m: f"d{min(len(m.group()), 20)}" if m.group()[0] in "0123456789" else "a"
    return _RUNS.sub(mark, token)


def cell_of(shape: str) -> int:
    """The hash cell a shape is counted in."""
    return zlib.crc32(shape.encode()) % SHAPE_BUCKETS


def _keys(token: str) -> list[str]:
    if "@" in token:
        return [token.lower()]
    digits = _DIGITS.sub("", token)
    return [digits[-k:] for k in (len(digits), 10, 7) if 7 <= k <= len(digits)]


def read_tokens(text: str, found: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> Tokens:
    out = Tokens([], [], [], [], [])
    marks = sorted([(s, e, k + 1) for k, s, e in found] + [(s, e, 0) for s, e in failed])
    at, last, reach = 0, 0, []
    for m in _ACTIVE.finditer(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = m.end()
        while start < last - 1 and text[start] in "\"'<[{,;:":
            start += 1
        end = last
        while end > start + 1 and text[end - 1] in "\"'>]}.,;:!?":
            end -= 1
        while at < len(marks) and marks[at][0] < end:
            reach.append(marks[at])
            at += 1
        reach = [x for x in reach if x[1] > start]
        token = text[start:end]
        keys = _keys(token)
        label = -1
        if reach:
            real = [x for x in reach if x[2]]
            label = min(x[2] for x in real) if real else 0
            for s, e, _ in real:                          # a token also stands for the whole it is part of
                keys += _keys(text[s:e])
        if out.span:
            gap = text[out.span[-1][1]:start]
            out.beside.append(gap.strip("\"'<>[]{}.,;:!?").isspace() and len(gap) <= 3)
        out.span.append((start, end))
        out.label.append(label)
        out.shape.append(shape_of(token))
        out.keys.append(list(dict.fromkeys(keys)))
    out.beside.append(False)
    _keys_of_parts(text, out)
    return out


def _keys_of_parts(text: str, t: Tokens) -> None:
    """Keys of numbers written in parts: the last 7 and 10 digits of tokens of
    digits side by side go to the last of them; chain links carry its label on."""
    digits = [_DIGITS.sub("", text[s:e]) if _PART.fullmatch(text, s, e) else "" for s, e in t.span]
    for i in range(1, len(digits)):
        joined, j = digits[i], i
        for k in (7, 10):
            while joined and len(joined) < k and j and t.beside[j - 1] and digits[j - 1]:
                j -= 1
                joined = digits[j] + joined
            if j < i and len(joined) >= k and joined[-k:] not in t.keys[i]:
                t.keys[i].append(joined[-k:])


def skip_links(t: Tokens) -> list[tuple[int, int]]:
    """Every token and the next one that shares a key with it: as many links as keys."""
    last: dict[str, int] = {}
    links: dict[tuple[int, int], None] = {}
    for i, keys in enumerate(t.keys):
        for k in keys:
            if k in last and last[k] != i:
                links[last[k], i] = None
            last[k] = i
    return list(links)


@dataclass
class Field:
    """Log potentials: of the labels by cell of the shape, of chain and of skip links."""
    shapes: dict[int, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _observe(t: Tokens, counts: Counter) -> None:
    """Counts of one document; tokens that no pattern matched count as unlabelled."""
    label = [max(0, y) for y in t.label]
    for s, y in zip(t.shape, label):
        counts["shape", str(cell_of(s)), y] += 1
    for i, y in enumerate(label):
        after = label[i + 1] if t.beside[i] else 0
        counts["chain", str(y), after] += 1
        if i == 0 or not t.beside[i - 1]:
            counts["chain", "0", y] += 1
    for i, j in skip_links(t):
        if t.label[i] >= 0 and t.label[j] >= 0:           # an open token says nothing about links
            a, b = sorted((label[i], label[j]))
            counts["skip", str(a), b] += 1


def train(docs: DataFrame) -> Field:
    """Potentials from all ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["part", "value", "label", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                if text and _ACTIVE.search(text):
                    _observe(read_tokens(text, *base_spans(text)), counts)
            if len(counts) > 50_000:
                yield flush()
                counts.clear()
        yield flush()

    sums = (arrow_map(docs.select("text"), run, "part string, value string, label int, n bigint")
            .groupBy("part", "value", "label").agg(F.sum("n").alias("n")))
    links = sums.where("part <> 'shape'").collect()                    # labels x labels rows
    by_shape = (sums.where("part = 'shape'").groupBy("value")
                .agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LABELS))]))
    told = F.expr(" + ".join(f"n{k}" for k in range(1, len(LABELS))))
    prior = by_shape.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(LABELS))]).first()
    kept = by_shape.where(told >= MIN_SHAPE).collect()                 # SHAPE_BUCKETS at most
    total = np.array([x or 0 for x in prior], float) + 1
    log_prior = np.log(total / total.sum())
    unseen = log_prior.copy()
    unseen[1:] -= UNSEEN
    shapes = {}
    for r in kept:
        n = np.array(r[1:], float) + 0.5
        shapes[int(r.value)] = np.log(n / n.sum())
    alone = np.exp(log_prior)
    tables = {part: len(LABELS) ** 2 * np.outer(alone, alone) for part in ("chain", "skip")}     # chance, until counts say more
    for r in links:
        tables[r.part][int(r.value), r.label] += r.n
    chain = tables["chain"] / tables["chain"].sum()
    chained = _beyond(chain, chain.sum(axis=1), chain.sum(axis=0))
    chained[tables["chain"].sum(axis=1) < 1] = 0.0                     # a label no chain was seen with says nothing
    chained[:, tables["chain"].sum(axis=0) < 1] = 0.0
    skip = tables["skip"] + tables["skip"].T + SAME * np.diag(alone)
    return Field(shapes, unseen, chained, _beyond(skip / skip.sum(), alone, alone))


def _beyond(pair: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far label pairs go beyond the labels' own shares."""
    return np.clip(np.log(pair / (left[:, None] * right[None, :])), -8, 8)


def marginals(t: Tokens, field: Field) -> np.ndarray:
    """Label marginals of every token by loopy sum-product message passing."""
    n, k = len(t.span), len(LABELS)
    unary = np.empty((n, k))
    for i, (s, y) in enumerate(zip(t.shape, t.label)):
        if y >= 0:
            unary[i] = -50.0
            unary[i, y] = 0.0
        else:
            unary[i] = field.shapes.get(cell_of(s), field.unseen)
    for i in range(n):                                    # plain words beside a token
        if not t.beside[i]:
            unary[i] += field.chain[:, 0]
        if i == 0 or not t.beside[i - 1]:
            unary[i] += field.chain[0]
    chain = [(i, i + 1) for i in range(n) if t.beside[i]]
    links = chain + skip_links(t)
    if not links:
        return _softmax(unary)
    a = np.array([x for x, _ in links] + [y for _, y in links])
    b = np.array([y for _, y in links] + [x for x, _ in links])
    m = len(links)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    pair = np.empty((2 * m, k, k))
    pair[:len(chain)], pair[len(chain):m] = field.chain, field.skip
    pair[m:m + len(chain)], pair[m + len(chain):] = field.chain.T, field.skip
    message = np.zeros((2 * m, k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, b, message)
        x = (belief[a] - message[back])[:, :, None] + pair
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, b, message)
    return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans the random field adds to them."""
    found, failed = base_spans(text)
    if not _ACTIVE.search(text):
        return found, []
    t = read_tokens(text, found, failed)
    if all(y >= 0 for y in t.label):
        return found, []
    p = marginals(t, field)
    added: list[tuple[int, int, int]] = []
    before = -2
    for i in np.flatnonzero((np.array(t.label) < 0) & (p[:, 1:].max(axis=1) >= SURE)).tolist():
        kind = int(p[i, 1:].argmax())
        start, end = t.span[i]
        if before == i - 1 and t.beside[i - 1] and added[-1][0] == kind:
            added[-1] = (kind, added[-1][1], end)
        else:
            added.append((kind, start, end))
        before = i
    return found, added


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_email, n_ip, n_card, n_phone (base
    matches), base_spans and spans (kind:start:end, by kind and start); these
    get underscores where such a column is there already."""
    shared = docs.sparkSession.sparkContext.broadcast(field)           # bounded by SHAPE_BUCKETS
    rest = [c for c in docs.columns if c != text_col]
    names, place = [], docs.columns.index(text_col)
    for name in (*(f"n_{k}" for k in KINDS), "base_spans", "spans"):
        names.append(fresh([*rest, *names], name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [all_spans(t or "", shared.value) for t in b.column(place).to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in read], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(b.columns) if i != place), *counts, pa.array([_written(base) for base, _ in read], pa.string()),
                 pa.array([_written(base + more) for base, more in read], pa.string())],
                names=[*rest, *names])

    kinds = ["bigint"] * len(KINDS) + ["string"] * 2
    return arrow_map(docs, run, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
                                          + [f"`{n}` {k}" for n, k in zip(names, kinds)]))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t, [x for part in all_spans(t, shared.value) for x in part])
                     for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)],
                                             names=names)

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    docs = docs.select("doc_id", "text")
    out = find(docs, train(docs))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
