"""Operator 9 — quality classifier from weak labels.

Two targets, ``junk`` and ``toxic``. For each, several heuristic labellers vote
1 (yes), 0 (no) or - (no opinion) on every document: rules on characters and
repetition, a lexicon mined from the labelled documents, and the ``labels`` table
itself. Expectation-maximisation over the counts of vote patterns (their number
depends on the labellers alone) estimates how each labeller votes on either
class; the posterior of a document's pattern labels it. A hashed linear scorer
(logistic regression over the presence of hashed tokens and style marks) is
trained on the posteriors and judges documents by their text alone.

Spark counts the tokens of all labelled documents by class and fold, near
copies once; the lexicon and the tokens that the scorer looks at are those
whose counts pass its tests. Weights are fitted on a sample of at most
``FIT_ROWS`` labelled documents (smallest id hashes), of which these tokens
alone reach the driver. A labelled document is voted on with a lexicon mined
without its fold, so that the lexicon's accuracy is estimated on documents it
was not made from. The vote patterns are counted over all documents, and all
are judged whole.

Defined cases: a null text is the empty text (no words; kept); documents
without label are voted on by the heuristics alone; several labels of a
document count as bad if any of them is; repeated rows are judged alike; with no
labelled document nothing is trained and all are kept; other columns pass
through ``judge`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import arrow_map, bit_filter, fresh, in_filter, mix64, prepare, stored, utf8, word_hashes

FIT_ROWS = 20_000             # labelled documents the scorer is fitted on
LEXICON_MIN = 3               # toxic documents with a lexicon token, at least,
LEXICON_LIFT = 20.0           # and how many times as often it is met as in the others
MIN_DOCS, MIN_Z = 8, 5.0      # support and significance of a token as a feature
MIN_MARKED = 2                # support of a style mark
STRETCH = 2_000_000           # tokens counted together before they are sent
PREFIXES, TIMES = (5, 6, 7), 3   # a beginning of so many bytes that so many tokens share is a token of its own
FOLDS = 3                     # labelled documents are voted on with the lexicon of the other folds
ANCHOR_RIGHT = 0.95           # accuracy of the labels table where it has an opinion
TWINS = 4                     # smallest hashes of which near copies share at least one
TARGETS = ("junk", "toxic")

_BREAK = np.ones(256, dtype=bool)                 # tokens: letters, digits and non-ASCII
_BREAK[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_lo:_hi] = False
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "%&$*#@^~<>{}\\="]] = 1
_PIPE = np.zeros(256, dtype=np.int64)
_PIPE[ord("|")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1


@dataclass
class Reading:
    """What a pass over a batch of texts finds: distinct tokens and frequent
    beginnings (document, hash), and shares by document."""
    doc: np.ndarray
    token: np.ndarray
    n_tokens: np.ndarray
    symbols: np.ndarray
    pipes: np.ndarray
    upper: np.ndarray
    top: np.ndarray
    distinct: np.ndarray
    stutter: np.ndarray
    signature: np.ndarray         # documents x TWINS


def read(texts: pa.Array) -> Reading:
    raw, off = utf8(texts)
    n = len(off) - 1

    def share_of(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask[raw]))
        return sums[off[1:]] - sums[off[:-1]]

    size = np.maximum(np.diff(off), 1)
    letters = np.maximum(share_of(_LETTER), 1)
    symbols, pipes, upper = share_of(_SYMBOL) / size, share_of(_PIPE), share_of(_UPPER) / letters
    hashes, counts, *heads = word_hashes(texts, _BREAK, PREFIXES)
    doc = np.repeat(np.arange(n), counts)
    tokens = np.maximum(counts, 1)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(hashes) else np.empty(0, bool)
    stutter = np.bincount(doc[same], minlength=n) / tokens
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], runs)
    kinds = np.bincount(d[at], minlength=n)
    low = np.full((TWINS, n), np.iinfo(np.uint64).max, np.uint64)      # smallest hashes of two neighbours
    if len(hashes) > 1:
        with np.errstate(over="ignore"):
            pair = hashes[:-1] * np.uint64(3) + hashes[1:]
            inside = doc[1:] == doc[:-1]
            for k in range(TWINS):
                np.minimum.at(low[k], doc[1:][inside], mix64(pair[inside] + np.uint64(k << 32)))
    docs, found = [d[at]], [h[at]]
    for head in heads:                                        # beginnings that several tokens share
        order = np.lexsort((head, doc))
        hd, hh = doc[order], head[order]
        first = np.flatnonzero(np.append(True, (hh[1:] != hh[:-1]) | (hd[1:] != hd[:-1]))) if len(hh) else np.empty(0, np.int64)
        often = first[(np.diff(np.append(first, len(hh))) >= TIMES) & (hh[first] != 0)]
        docs.append(hd[often])
        found.append(hh[often])
    return Reading(np.concatenate(docs), np.concatenate(found), counts, symbols, pipes / tokens, upper, top / tokens,
                   kinds / tokens, stutter, low.T)


def _marks(yes: np.ndarray, no: np.ndarray | None = None) -> np.ndarray:
    out = np.full(len(yes), -1, np.int8)
    if no is not None:
        out[no] = 0
    out[yes] = 1
    return out


def junk_votes(r: Reading) -> np.ndarray:
    """documents x labellers, 1, 0 or -1 (no opinion)."""
    long = r.n_tokens >= 20
    plain = (r.symbols < 0.005) & (r.pipes < 0.02) & (r.upper < 0.15) & (r.stutter < 0.05) & (r.top < 0.2)
    odd = (r.symbols > 0.01) | (r.pipes > 0.05) | (r.upper > 0.25) | (r.stutter > 0.1)
    return np.stack([_marks(r.symbols > 0.015), _marks(r.pipes > 0.1), _marks((r.upper > 0.3) & long),
                     _marks((r.stutter > 0.2) & long), _marks((r.distinct < 0.12) & (r.n_tokens >= 50)),
                     _marks(odd & long, plain)], axis=1)


def toxic_votes(n: int, doc: np.ndarray, token: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """By the number of distinct lexicon tokens; without a lexicon no opinion."""
    hits = np.bincount(doc[np.isin(token, lexicon)], minlength=n)
    none = (hits == 0) & (len(lexicon) > 0)
    return np.stack([_marks(hits >= 1, none), _marks(hits >= 2, none), _marks(hits >= 3, none)], axis=1)


_MARKS = [("symbols", (0.005, 0.01, 0.02), 3), ("pipes", (0.03, 0.06, 0.12), 3), ("upper", (0.2, 0.3, 0.45), 3),
          ("stutter", (0.05, 0.1, 0.25), 10), ("distinct", (0.2, 0.12, 0.06), 20)]
_HITS = (1, 2, 3, 5)
MARK_HASHES = mix64(np.arange(1, 16 * (len(_MARKS) + 1) + 1, dtype=np.uint64) << np.uint64(40))


def style_marks(r: Reading) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) pairs for the levels that a share of style passes."""
    docs, marks = [], []
    for kind, (name, levels, least) in enumerate(_MARKS):
        share = getattr(r, name)
        for level, bound in enumerate(levels):
            over = np.flatnonzero(((share < bound) if name == "distinct" else (share > bound)) & (r.n_tokens >= least))
            docs.append(over)
            marks.append(np.full(len(over), MARK_HASHES[16 * kind + level], np.uint64))
    return np.concatenate(docs), np.concatenate(marks)


def lexicon_marks(n: int, doc: np.ndarray, token: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) pairs for the numbers of lexicon tokens that are reached."""
    hits = np.bincount(doc[np.isin(token, lexicon)], minlength=n)
    docs = [np.flatnonzero(hits >= k) for k in _HITS]
    marks = [np.full(len(d), MARK_HASHES[16 * len(_MARKS) + i], np.uint64) for i, d in enumerate(docs)]
    return np.concatenate(docs), np.concatenate(marks)


def _fit(onehot: np.ndarray, counts: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of the class and P(vote | class) when pattern ``r`` has it with probability ``q[r]``."""
    table = np.zeros((onehot.shape[1], 2, 3))
    for y, weight in ((0, (1 - q) * counts), (1, q * counts)):
        table[:, y, :] = (np.einsum("r,rkv->kv", weight, onehot) + 0.1) / (weight.sum() + 0.3)
    return float(np.clip((q * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4)), table


def _anchored(table: np.ndarray) -> np.ndarray:
    """The share of classes left as they are, the votes right ANCHOR_RIGHT of the time."""
    out, voted = table.copy(), 1 - table[:, 2]
    out[0, 0], out[0, 1] = voted[0] * ANCHOR_RIGHT, voted[0] * (1 - ANCHOR_RIGHT)
    out[1, 1], out[1, 0] = voted[1] * ANCHOR_RIGHT, voted[1] * (1 - ANCHOR_RIGHT)
    return np.clip(out, 1e-6, 1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200,
                             anchor: int | None = None) -> tuple[float, np.ndarray]:
    """patterns: votes (rows) of labellers (columns) in 1, 0, -1. The share of
    the positive class and P(vote | class) as labellers x classes x votes. The
    first guess is any vote for the class. The labeller ``anchor`` is taken to
    be right ANCHOR_RIGHT of the time it votes; where it votes at all, the first
    guess is its votes alone."""
    k = patterns.shape[1]
    onehot = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)      # rows, labellers, votes
    q = np.clip((patterns == 1).any(axis=1) * 0.9 + 0.05, 0, 1)
    prior, table = 0.5, np.zeros((k, 2, 3))
    if anchor is not None and (patterns[:, anchor] >= 0).any():
        known = patterns[:, anchor] >= 0
        q, table = _fit(onehot[known], counts[known], np.where(patterns[known, anchor] == 1, 0.95, 0.05))
        table[anchor] = _anchored(np.tile([known.mean() / 2, known.mean() / 2, 1 - known.mean()], (2, 1)))
        q = posterior(patterns, q, table)
    for _ in range(rounds):
        prior, table = _fit(onehot, counts, q)
        if anchor is not None:
            table[anchor] = _anchored(table[anchor])
            if (known := patterns[:, anchor] >= 0).any():             # where it votes it also tells the class's share
                prior = float(np.clip((q * counts)[known].sum() / counts[known].sum(), 1e-4, 1 - 1e-4))
        before, q = q, posterior(patterns, prior, table)
        if np.abs(q - before).max() < 1e-6:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    at = np.where(patterns < 0, 2, patterns)
    k = np.arange(patterns.shape[1])
    ll = np.log(table[k[None, :], :, at]).sum(axis=1)                                  # rows, classes
    odds = np.log(prior) - np.log(1 - prior) + ll[:, 1] - ll[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


@dataclass
class Scorer:
    """Sorted feature hashes, a weight for each, and the intercept."""
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, n: int, doc: np.ndarray, token: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.features, token), len(self.features) - 1)
        hit = self.features[at] == token
        z = self.bias + np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train_scorer(n: int, doc: np.ndarray, token: np.ndarray, q: np.ndarray, features: np.ndarray, ridge: float = 0.05) -> Scorer:
    """Logistic regression on soft labels ``q`` over the presence of ``features`` and style marks."""
    base = float(np.clip(q.mean(), 1e-4, 1 - 1e-4)) if n else 0.01
    bias = np.log(base / (1 - base))
    if not len(doc):
        return Scorer(np.empty(0, np.uint64), np.empty(0), bias)
    kinds, at = np.unique(token, return_inverse=True)
    seen = np.bincount(at)
    keep = np.isin(kinds, features) | np.isin(kinds, MARK_HASHES) & (seen >= MIN_MARKED)
    place = np.full(len(kinds), -1)
    place[keep] = np.arange(keep.sum())
    use = keep[at]
    rows, cols = doc[use], place[at[use]]
    m = int(keep.sum())
    w, step, grad_w, grad_b = np.zeros(m), 0.5, np.zeros(m), 1e-8
    for _ in range(400):                                   # AdaGrad on the whole sample
        z = bias + np.bincount(rows, weights=w[cols], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - q
        g = np.bincount(cols, weights=err[rows], minlength=m) + ridge * w
        grad_w += g * g
        grad_b += err.sum() ** 2
        w -= step * g / np.sqrt(grad_w + 1e-8)
        bias -= step * err.sum() / np.sqrt(grad_b + 1e-8)
    return Scorer(kinds[keep], w, float(bias))


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, told (hash of the tokens), tokens of the documents of ``docs``
    whose id is, or hashes like one, in ``wanted``."""
    ids = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(ids.value, b.column("key").to_numpy().view(np.uint64))))
            if b.num_rows:
                r = read(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_told(b.num_rows, r)), _lists(b.num_rows, r.doc, r.token)],
                                                 names=["doc_id", "told", "tokens"])

    return arrow_map(_texts(docs), run, "doc_id bigint, told bigint, tokens array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _told(n: int, r: Reading) -> np.ndarray:
    """A hash of every document's tokens."""
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        np.add.at(out, r.doc, mix64(r.token))
    return mix64(out).view(np.int64)


def token_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """token and, by fold k and target, n_<target>k and yes_<target>k: the
    documents of ``labelled`` with the token, and those of the class."""
    cells = [f"{part}_{t}{k}" for t in TARGETS for k in range(FOLDS) for part in ("n", "yes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, cell = (np.concatenate(x) for x in zip(*held))
            kinds, at = np.unique(token, return_inverse=True)
            table = np.bincount(at * len(cells) + cell, minlength=len(kinds) * len(cells)).reshape(len(kinds), -1)
            return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(table[:, c].astype(np.int32)) for c in range(len(cells)))],
                                              names=["token", *cells])

        for b in batches:
            rows = pa.Table.from_batches([b])
            doc, token = _flat(rows.column("tokens"))
            token = token.view(np.int64)
            fold = b.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
            for t, target in enumerate(TARGETS):
                gold = b.column(f"gold_{target}").to_numpy(zero_copy_only=False).astype(float)
                for part, use in enumerate((~np.isnan(gold), gold == 1)):
                    pick = use[doc]
                    held.append((token[pick], (2 * (t * FOLDS + fold) + part)[doc[pick]]))
            size += len(token)
            if size >= STRETCH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    known = labelled.select("doc_id", "told", "fold", *(f"gold_{t}" for t in TARGETS))
    # sorted and merged at every size; equal rows of a document meet there and count once
    rows = tokens_of(docs, labelled).join(known.hint("merge"), ["doc_id", "told"]).dropDuplicates(["doc_id", "told"])
    counted = arrow_map(rows.select("tokens", "fold", *(f"gold_{t}" for t in TARGETS)), run,
                        "token bigint, " + ", ".join(f"{c} int" for c in cells))
    return counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in cells])


def _sums(target: str, folds: list[int]) -> tuple[Column, Column]:
    """Documents with the token, and those of the class, in ``folds``."""
    return tuple(reduce(lambda a, b: a + b, [F.col(f"{part}_{target}{k}") for k in folds]) for part in ("n", "yes"))


def mine_lexicon(counts: DataFrame, totals: dict[str, int], without: int | None = None) -> np.ndarray:
    """Tokens far more frequent in toxic documents than in others, beyond what
    the best of so many tokens would be by chance; a fold left out."""
    folds = [k for k in range(FOLDS) if k != without]
    n, n_yes = (sum(totals[f"{part}_toxic{k}"] for k in folds) for part in ("n", "yes"))
    n_no = n - n_yes
    if not n_yes or not n_no:
        return np.empty(0, np.uint64)
    seen, yes = _sums("toxic", folds)
    lift = ((yes + 0.5) / (n_yes + 1)) / ((seen - yes + 0.5) / (n_no + 1))
    share, base = F.least(F.greatest(F.try_divide(yes, seen), F.lit(1e-9)), F.lit(1 - 1e-9)), n_yes / n
    surprise = seen * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    tried = counts.where(seen >= LEXICON_MIN).count()
    found = counts.where((yes >= LEXICON_MIN) & (lift >= LEXICON_LIFT) & (surprise > float(np.log(max(1, tried)))))
    return np.sort(found.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def feature_tokens(counts: DataFrame, totals: dict[str, int], target: str) -> np.ndarray:
    """Tokens whose presence tells significantly for the class."""
    seen, yes = _sums(target, [*range(FOLDS)])
    n, n_yes = (sum(totals[f"{part}_{target}{k}"] for k in range(FOLDS)) for part in ("n", "yes"))
    base = min(max(n_yes / n, 1e-4), 1 - 1e-4) if n else 0.01
    z = (yes - seen * base) / F.sqrt(seen * base * (1 - base))
    found = counts.where((seen >= MIN_DOCS) & (yes / seen > 0.5)).where(z >= MIN_Z)
    return np.sort(found.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def labelled_documents(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """key (hash of the id), doc_id, told, marks, junk (votes), gold_junk,
    gold_toxic, fold of the labelled documents, near copies (a smallest hash in
    common) once."""
    ids = docs.sparkSession.sparkContext.broadcast(bit_filter(gold.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(ids.value, b.column("key").to_numpy().view(np.uint64))))
            if b.num_rows:
                r, n = read(b.column("text")), b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("doc_id"), pa.array(_told(n, r)), _lists(n, np.repeat(np.arange(n), TWINS), r.signature.ravel()),
                     _lists(n, *style_marks(r)), pa.array(_vote_code(junk_votes(r)), pa.string())],
                    names=["key", "doc_id", "told", "twins", "marks", "junk"])

    found = arrow_map(_texts(docs), run, "key bigint, doc_id bigint, told bigint, twins array<bigint>, marks array<bigint>, junk string")
    rows = stored(found.join(gold.hint("merge"), "doc_id").withColumn("row", F.struct("key", "doc_id", "told")), "labelled")
    heads = rows.select("row", F.posexplode("twins")).groupBy("pos", "col").agg(F.min("row").alias("row"))
    single = heads.groupBy("row").count().where(F.col("count") == TWINS).select("row")
    return rows.dropDuplicates(["row"]).join(single, "row", "left_semi").drop("row", "twins")


@dataclass
class Model:
    lexicon: np.ndarray
    scorers: dict[str, Scorer]
    accuracies: dict[str, tuple[float, np.ndarray]]


def _gold(labels: DataFrame) -> DataFrame:
    return (labels.where("doc_id is not null").groupBy("doc_id")
            .agg((F.min("quality") == 0).cast("int").alias("gold_junk"), (F.max("toxic") == 1).cast("int").alias("gold_toxic")))


def _lists(n: int, doc: np.ndarray, value: np.ndarray) -> pa.ListArray:
    order = np.argsort(doc, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)),
                                    pa.array(value[order].view(np.int64)))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) pairs of a list column."""
    sizes = np.array([len(x) for part in column.chunks for x in part], np.int64)
    values = [part.flatten().to_numpy(zero_copy_only=False) for part in column.chunks]
    return np.repeat(np.arange(len(sizes)), sizes), (np.concatenate(values) if values else np.empty(0, np.int64)).view(np.uint64)


def _vote_code(v: np.ndarray) -> list[str]:
    return ["".join("01-"[x] for x in row) for row in v]


def _vote_matrix(codes: list[str]) -> np.ndarray:
    return np.array([[-1 if c == "-" else int(c) for c in code] for code in codes], np.int8)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality, toxic)."""
    spark = docs.sparkSession
    prepare(spark)
    gold = _gold(labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    labelled = stored(labelled_documents(docs, gold), "labelled-once")
    by_fold = labelled.groupBy("fold").agg(*[f.alias(f"{part}_{t}") for t in TARGETS for part, f in (
        ("n", F.count(f"gold_{t}")), ("yes", F.count_if(F.col(f"gold_{t}") == 1)))]).collect()
    totals = {f"{part}_{t}{k}": 0 for t in TARGETS for part in ("n", "yes") for k in range(FOLDS)}
    totals |= {f"{part}_{t}{r.fold}": r[f"{part}_{t}"] for r in by_fold for t in TARGETS for part in ("n", "yes")}
    counts = stored(token_counts(docs, labelled), "token-counts")
    lexicons = [mine_lexicon(counts, totals, k) for k in range(FOLDS)]
    lexicons.append(mine_lexicon(counts, totals))
    features = {t: feature_tokens(counts, totals, t) for t in TARGETS}
    told = spark.sparkContext.broadcast(np.unique(np.concatenate([*lexicons, *features.values()])))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, token = _flat(pa.Table.from_batches([b]).column("tokens"))
            keep = np.isin(token, told.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], _lists(b.num_rows, doc[keep], token[keep])], names=b.schema.names)

    chosen = labelled.orderBy("key", "doc_id", "told").limit(FIT_ROWS).select("doc_id", "told", "marks", "junk", "gold_junk", "gold_toxic", "fold")
    picked = tokens_of(docs, chosen)
    drawn = (arrow_map(picked, sampled, picked.schema).dropDuplicates(["doc_id", "told"]).join(chosen, ["doc_id", "told"])
             .select("tokens", "marks", "junk", "gold_junk", "gold_toxic", "fold").toArrow())
    n = drawn.num_rows
    golds = {t: drawn.column(f"gold_{t}").to_numpy().astype(float) for t in TARGETS}
    doc, token = _flat(drawn.column("tokens"))
    fold = drawn.column("fold").to_numpy()
    shared = spark.sparkContext.broadcast(lexicons)
    codes = [f"toxic{k}" for k in range(FOLDS + 1)]

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = read(b.column("text"))
            by_fold = [pa.array(_vote_code(toxic_votes(b.num_rows, r.doc, r.token, x)), pa.string()) for x in shared.value]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_vote_code(junk_votes(r)), pa.string()), *by_fold],
                                             names=["doc_id", "junk", *codes])

    by_doc = arrow_map(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), voted,
                       "doc_id bigint, junk string, " + ", ".join(f"{c} string" for c in codes))
    with_gold = (by_doc.join(gold, "doc_id", "left")
                 .withColumn("toxic", F.coalesce(*[F.when(F.col("fold") == k, F.col(codes[k])) for k in range(FOLDS)], codes[-1]))
                 .select(*[F.concat(t, F.coalesce(F.col(f"gold_{t}").cast("string"), F.lit("-"))).alias(t) for t in TARGETS]))
    tables = {}
    counted = with_gold.groupBy(*TARGETS).count().collect()          # at most 3 ** labellers rows
    for t in TARGETS:
        seen: dict[str, int] = {}
        for r in counted:
            seen[r[t]] = seen.get(r[t], 0) + r["count"]
        if seen:
            patterns = _vote_matrix(sorted(seen))
            tables[t] = expectation_maximisation(patterns, np.array([seen[c] for c in sorted(seen)], float),
                                                 anchor=patterns.shape[1] - 1)
    scorers = {}
    marked = [lexicon_marks(n, doc, token, x) for x in lexicons[:FOLDS]]
    mark_doc, mark = _flat(drawn.column("marks"))
    all_doc = np.concatenate([doc, mark_doc, *(d[fold[d] == k] for k, (d, _) in enumerate(marked))])
    all_token = np.concatenate([token, mark, *(m[fold[d] == k] for k, (d, m) in enumerate(marked))])
    for t in TARGETS:
        if not n or t not in tables:
            scorers[t] = Scorer(np.empty(0, np.uint64), np.empty(0), -10.0)
            continue
        if t == "junk":
            text_votes = _vote_matrix(drawn.column("junk").to_pylist())
        else:
            text_votes = np.stack([toxic_votes(n, doc, token, x) for x in lexicons[:FOLDS]])[fold, np.arange(n)]
        g = golds[t]
        full = np.column_stack([text_votes, np.where(np.isnan(g), -1, np.nan_to_num(g)).astype(np.int8)])
        scorers[t] = train_scorer(n, all_doc, all_token, posterior(full, *tables[t]), features[t])
    return Model(lexicons[-1], scorers, tables)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with p_junk, p_toxic and keep (both below one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    new = [fresh(names, c) for c in ("p_junk", "p_toxic", "keep")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = read(b.column("text"))
            parts = [(r.doc, r.token), style_marks(r), lexicon_marks(b.num_rows, r.doc, r.token, shared.value.lexicon)]
            doc, token = (np.concatenate(x) for x in zip(*parts))
            p = [shared.value.scorers[t].score(b.num_rows, doc, token) for t in TARGETS]
            keep = (p[0] < 0.5) & (p[1] < 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[0]), pa.array(p[1]), pa.array(keep)], names=[*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, `{new[0]}` double, `{new[1]}` double, `{new[2]}` boolean")
