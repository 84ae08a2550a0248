"""Operator 5 — hidden Markov language model.

A text's words belong to hashed classes (the end of the text has its own). A
hidden Markov chain emits the classes, and a class emits its words by their
add-one frequency, with one share for unknown words; both are proper, so the
score is the log10 probability of the text. Baum-Welch counts are gathered
from all training documents, every partition its own sums, and added by Spark;
what reaches the driver is bounded by classes times states. Scores come from
the scaled forward recursion over the whole text (as products of the transfer
matrices of its stretches, which is the same recursion).

Word counts grow with the corpus and stay distributed: texts are read once into
chunks (local vocabulary and word numbers), the vocabularies' parts of the hash
space meet in one task each, and counts go back to the chunks that asked.

Defined cases: a null or empty text is the end alone; with no training document
every count is 0 and the base probability of a token is 1; documents without id
hash like the empty string; repeated rows count and are scored each; words are
told apart by 64-bit hashes; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import arrow_map, partitions, prepare, stored, word_hashes

CLASS_BITS = 14
CLASSES = 1 << CLASS_BITS
END = CLASSES                 # the class of a text's end
STATES, ROUNDS = 6, 5
STRETCH = 256                 # tokens of a stretch in training and in transfer matrices
CHUNK_TOKENS, CHUNK_DOCS = 256_000, 20_000
PART_ENTRIES = 400_000        # vocabulary entries that meet in one task
FOLDS, HELD = 7, 2
SMOOTH = 2.0                  # weight of the class frequencies in every state's emissions


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def classes_of(kinds: np.ndarray) -> np.ndarray:
    return (kinds >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def read_chunks(docs: DataFrame) -> DataFrame:
    """One row a chunk of documents: ids, whether held out, words of each, word
    numbers, and the sorted hashes, their classes and the training counts of
    the local vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, lens, hashes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            number += 1
            words, n = np.concatenate(hashes), np.concatenate(lens)
            held = np.fromiter(map(held_out, ids), bool, len(ids))
            kinds, at = np.unique(words, return_inverse=True)
            counts = np.bincount(at[np.repeat(~held, n)], minlength=len(kinds))
            at = at.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
            blobs = (held, n.astype(np.int32), at, kinds, classes_of(kinds).astype(np.uint16), counts.astype(np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number]), pa.array([ids], pa.list_(pa.int64())),
                 *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
                names=["chunk", "doc_ids", "held", "lens", "at", "kinds", "classes", "counts"])

        for b in batches:
            h, n = word_hashes(b.column("text"))
            ids += b.column("doc_id").to_pylist()
            lens.append(n)
            hashes.append(h)
            size += len(h)
            if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield flush()
                ids, lens, hashes, size = [], [], [], 0
        if ids:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), run, "chunk bigint, doc_ids array<bigint>, held binary, lens binary, "
                                                         "at binary, kinds binary, classes binary, counts binary")


def word_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """chunk, part, counts: training counts in the whole corpus of a chunk's
    vocabulary, part by part of the hash space; and for every part one row of
    chunk -1 with the tokens and distinct words of its classes."""
    spark = chunks.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, kinds, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "kinds", "counts"))):
                kinds, counts = np.frombuffer(kinds, np.uint64), np.frombuffer(counts, np.uint32)
                part = classes_of(kinds) * parts // CLASSES               # sorted like the hashes
                own, first = np.unique(part, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()),
                     pa.array([x.tobytes() for x in np.split(kinds, first[1:])][:len(own)], pa.binary()),
                     pa.array([x.tobytes() for x in np.split(counts, first[1:])][:len(own)], pa.binary())],
                    names=["part", "chunk", "kinds", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            kinds, at = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c for _, _, c in held])).astype(np.int64)
            ends = np.cumsum([len(k) for _, k, _ in held])
            answers = np.split(total[at].astype(np.uint32 if total.max() < 1 << 32 else np.int64), ends[:-1])
            for i in range(0, len(held), 200):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in held[i:i + 200]], pa.int64()), pa.array([part] * len(held[i:i + 200]), pa.int64()),
                     pa.array([x.tobytes() for x in answers[i:i + 200]], pa.binary()),
                     pa.array([answers[0].itemsize] * len(held[i:i + 200]), pa.int64())], names=["chunk", "part", "counts", "width"])
            cls, at = np.unique(classes_of(kinds), return_inverse=True)
            table = np.stack([cls, np.bincount(at, weights=total).astype(np.int64), np.bincount(at, weights=total > 0).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([part], pa.int64()), pa.array([table.tobytes()], pa.binary()),
                                              pa.array([8])], names=["chunk", "part", "counts", "width"])

        for b in batches:
            for k, chunk, kinds, counts in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "kinds", "counts"))):
                if k != part and held:
                    yield from flush()
                    held = []
                part = k
                held.append((chunk, np.frombuffer(kinds, np.uint64), np.frombuffer(counts, np.uint32)))
        if held:
            yield from flush()

    dealt = arrow_map(chunks.select("chunk", "kinds", "counts"), deal, "part bigint, chunk bigint, kinds binary, counts binary")
    tasks = max(partitions(spark), min(parts, 4 * partitions(spark)))
    return arrow_map(dealt.repartition(tasks, "part").sortWithinPartitions("part", "chunk"), meet,
                     "chunk bigint, part bigint, counts binary, width bigint")


@dataclass
class Model:
    start: np.ndarray             # states
    middle: np.ndarray            # states, where a stretch starts within a text
    step: np.ndarray              # states x states
    emit: np.ndarray              # classes + end x states


def first_model(frequency: np.ndarray) -> Model:
    """Sticky states whose emissions differ by chance from the class frequencies."""
    rng = np.random.Generator(np.random.PCG64(11))
    emit = frequency[:, None] * (0.5 + rng.random((len(frequency), STATES)))
    emit[END] = frequency[END]
    step = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
    np.fill_diagonal(step, 0.95)
    even = np.full(STATES, 1 / STATES)
    return Model(even, even, step, emit / emit.sum(axis=0))


@dataclass
class Stretches:
    """Tokens of texts (each with its end) cut into stretches, longest first."""
    cls: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    first: np.ndarray             # whether a stretch starts its text
    text: np.ndarray

    def rows(self, t: int) -> np.ndarray:
        """Token places of the stretches longer than ``t``."""
        return self.begin[:np.searchsorted(-self.size, -t, side="left")] + t


def cut(cls: np.ndarray, lens: np.ndarray) -> Stretches:
    n = lens + 1
    ends = np.cumsum(n)
    out = np.full(int(n.sum()), END, np.int64)
    words = np.ones(len(out), bool)
    words[ends - 1] = False
    out[words] = cls
    pieces = -(-n // STRETCH)
    text = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - n)[text] + k * STRETCH
    size = np.minimum(STRETCH, n[text] - k * STRETCH)
    order = np.argsort(-size, kind="stable")
    return Stretches(out, begin[order], size[order], (k == 0)[order], text[order])


def expected_counts(m: Model, s: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over stretches: emission, transition and start counts."""
    n, longest = len(s.cls), int(s.size[0]) if len(s.size) else 0
    alpha, scale = np.empty((n, STATES)), np.empty(n)
    a = None
    for t in range(longest):
        at = s.rows(t)
        b = m.emit[s.cls[at]]
        a = np.where(s.first[:, None], m.start, m.middle) * b if t == 0 else (a[:len(at)] @ m.step) * b
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[at], scale[at] = a, c
    steps = np.zeros((STATES, STATES))
    beta = np.ones((len(s.begin), STATES))
    for t in range(longest - 2, -1, -1):
        at = s.rows(t + 1)
        ahead = m.emit[s.cls[at]] * beta[:len(at)] / scale[at][:, None]
        steps += alpha[at - 1].T @ ahead
        alpha[at] *= beta[:len(at)]                       # now the posterior
        beta[:len(at)] = ahead @ m.step.T
    at = s.rows(0)
    alpha[at] *= beta[:len(at)]
    emits = np.stack([np.bincount(s.cls, weights=alpha[:, k], minlength=CLASSES + 1) for k in range(STATES)], axis=1)
    starts = np.stack([alpha[s.begin[s.first]].sum(axis=0), alpha[s.begin[~s.first]].sum(axis=0)])
    return emits, steps * m.step, starts


def log_likelihood(m: Model, s: Stretches, n_texts: int) -> np.ndarray:
    """Exact natural-log probability of every text's classes: a stretch becomes
    the scaled product of its step matrices, a text the product of its stretches."""
    k = len(s.begin)
    product, logs = np.broadcast_to(np.eye(STATES), (k, STATES, STATES)).copy(), np.zeros(k)
    for t in range(int(s.size[0]) if k else 0):
        at = s.rows(t)
        p = product[:len(at)]
        if t == 0:
            p = np.where(s.first[:, None, None], p, p @ m.step)      # a text's first word needs no step
        else:
            p = p @ m.step
        p = p * m.emit[s.cls[at]][:, None, :]
        c = p.max(axis=(1, 2))
        product[:len(at)] = p / c[:, None, None]
        logs[:len(at)] += np.log(c)
    out = np.zeros(n_texts)
    order = np.lexsort((s.begin, s.text))
    texts = s.text[order]
    turn = np.arange(k) - np.searchsorted(texts, texts)
    v = np.tile(m.start, (n_texts, 1))
    for r in range(int(turn.max()) + 1 if k else 0):
        now = order[turn == r]
        who = s.text[now]
        x = np.einsum("ns,nst->nt", v[who], product[now])
        c = x.sum(axis=1)
        v[who] = x / c[:, None]
        out[who] += np.log(c) + logs[now]
    return out


def baum_welch(chunks: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``rounds`` of expectation-maximisation over all training texts of ``chunks``."""
    spark = chunks.sparkSession
    model = first_model(frequency)
    names = [f"s{k}" for k in range(STATES)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)                  # classes x states numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emits, steps, starts = np.zeros((CLASSES + 1, STATES)), np.zeros((STATES, STATES)), np.zeros((2, STATES))
            for b in batches:
                for row in b.to_pylist():
                    held, lens, at, classes = _arrays(row)
                    train = ~held
                    cls = classes[at[np.repeat(train, lens)]]
                    if train.any():
                        e, t, s = expected_counts(m, cut(cls, lens[train]))
                        emits, steps, starts = emits + e, steps + t, starts + s
            table = np.concatenate([emits, steps, starts])
            some = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, k]) for k in range(STATES))], names=["row", *names])

        sums = (arrow_map(chunks.select("held", "lens", "at", "classes"), run, "row bigint, " + ", ".join(f"{x} double" for x in names))
                .groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toArrow())      # CLASSES + 1 + STATES + 2 rows
        table = np.zeros((CLASSES + 1 + STATES + 2, STATES))
        table[sums.column("row").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1)
        emits, steps, starts = table[:CLASSES + 1], table[CLASSES + 1:-2] + 0.1, table[-2:] + 0.1
        emits = emits + SMOOTH * frequency[:, None] * max(1.0, emits.sum() / STATES / 1000)
        model = Model(starts[0] / starts[0].sum(), starts[1] / starts[1].sum(), steps / steps.sum(axis=1, keepdims=True),
                      emits / emits.sum(axis=0))
        shared.unpersist()
    return model


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether held out, words, word numbers, and the classes these number."""
    classes = np.frombuffer(row["classes"], np.uint16).astype(np.int64)
    at = np.frombuffer(row["at"], np.uint16 if len(classes) <= 1 << 16 else np.uint32)
    return np.frombuffer(row["held"], bool), np.frombuffer(row["lens"], np.int32).astype(np.int64), at, classes


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    chunks = stored(read_chunks(docs), "chunks")
    size = chunks.select(F.sum(F.octet_length("kinds") / 8).alias("n")).first().n or 0
    counts = stored(word_counts(chunks, min(CLASSES, max(partitions(spark), int(size) // PART_ENTRIES + 1))), "counts")
    seen, kinds = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    for row in counts.where("chunk = -1").select("counts").toArrow().column("counts").to_pylist():     # classes in all
        cls, n, v = np.frombuffer(row, np.int64).reshape(3, -1)
        seen[cls] += n
        kinds[cls] += v

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([int((~np.frombuffer(x, bool)).sum()) for x in b.column("held").to_pylist()], pa.int64())], names=["n"])

    n_ends = arrow_map(chunks.select("held"), ends, "n bigint").agg(F.sum("n").alias("n")).first().n or 0
    seen[END], kinds[END] = n_ends, int(n_ends > 0)
    total, distinct = int(seen.sum()), int(kinds.sum())
    frequency = (seen + 1) / (total + CLASSES + 1)
    model = baum_welch(chunks, frequency, rounds)
    inside = spark.sparkContext.broadcast((model, seen, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen, kinds_of = inside.value
        head, parts = None, []

        def flush() -> pa.RecordBatch:
            held, lens, at, cls = _arrays(head)
            c = np.concatenate(parts) if parts else np.empty(0, np.int64)
            s = cut(cls[at], lens)
            hidden = log_likelihood(m, s, len(lens)) / np.log(10)
            word = np.log10((c + 1) / (seen[cls] + kinds_of[cls] + 1))
            base = np.log10((c + 1) / (total + distinct + 1))
            doc = np.repeat(np.arange(len(lens)), lens)
            add = lambda x: np.bincount(doc, weights=x[at], minlength=len(lens))
            return pa.RecordBatch.from_arrays(
                [pa.array(head["doc_ids"], pa.int64()), pa.array(held), pa.array(lens + 1),
                 pa.array(add((c > 0).astype(float)).astype(np.int64) + int(n_ends > 0)), pa.array(np.full(len(lens), total)),
                 pa.array(add(base) + np.log10((n_ends + 1) / (total + distinct + 1))), pa.array(hidden + add(word))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for row in b.to_pylist():
                if row["part"] < 0:
                    if head is not None:
                        yield flush()
                    head, parts = row, []
                else:
                    parts.append(np.frombuffer(row["counts"], np.uint32 if row["width"] == 4 else np.int64).astype(np.int64))
        if head is not None:
            yield flush()

    heads = chunks.drop("counts", "kinds").withColumns({"part": F.lit(-1).cast("bigint")})
    both = heads.unionByName(counts.where("chunk >= 0"), allowMissingColumns=True)
    gathered = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "part")
    return arrow_map(gathered, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                    "base_score double, score double")
