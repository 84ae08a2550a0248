"""Base scores against plain counting, likelihoods against enumeration of paths, and held-out gain."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from verdant.llm import hmm_lm as H


def corpus():
    rnd = random.Random(6)
    tongues = [["".join(rnd.choices(abc, k=rnd.randrange(2, 6))) for _ in range(150)] for abc in ("abcde", "mnopq", "uvwxyz")]
    rows = [(i, " ".join(x.title() if k % 9 == 0 else x for k, x in enumerate(rnd.choices(tongues[i % 3], k=rnd.choice([3, 60, 300, 900])))))
            for i in range(240)]
    return rows + [(1000, None), (1001, ""), (1002, "\t \n"), (1003, "unseen " * 5), (7, rows[7][1]), (None, "ab cd")]


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def test_base_score_and_gain(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, part int").repartition(4)
    out = H.score(df).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in out) == want
    mine = [r for r in out if r.held_out and r.n_tokens > 50]
    assert mine and sum(r.score for r in mine) > sum(r.base_score for r in mine) + 0.2 * sum(r.n_tokens for r in mine)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(40) if H.held_out(i)], "doc_id bigint, text string")
    out = H.score(df).collect()
    assert out and all(r.base_score == 0.0 and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert H.score(df.limit(0)).collect() == []


@pytest.mark.parametrize("stretch", [2, 3, 100])
def test_likelihood_and_counts_by_enumeration(monkeypatch, stretch):
    monkeypatch.setattr(H, "STATES", 2)
    monkeypatch.setattr(H, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    emit = np.full((H.CLASSES + 1, 2), 1e-9)
    emit[[1, 2, 3, H.END]] = rng.random((4, 2))
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = H.Model(norm(rng.random(2)), norm(rng.random(2)), norm(rng.random((2, 2))), emit)
    lens = np.array([4, 0, 6, 1])
    cls = rng.integers(1, 4, int(lens.sum()))
    got = H.log_likelihood(m, H.cut(cls, lens), len(lens))
    at = 0
    steps = np.zeros((2, 2))
    for k, n in enumerate(lens):
        seq = [*cls[at:at + n], H.END]
        at += n
        total, own = 0.0, np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(seq)):
            p = m.start[path[0]] * emit[seq[0], path[0]]
            for x, y, w in zip(path, path[1:], seq[1:]):
                p *= m.step[x, y] * emit[w, y]
            total += p
            for x, y in zip(path, path[1:]):
                own[x, y] += p
        steps += own / total
        assert got[k] == pytest.approx(math.log(total))
    if stretch == 100:
        emits, found, starts = H.expected_counts(m, H.cut(cls, lens))
        assert np.allclose(found, steps) and starts[0].sum() == pytest.approx(len(lens))
        assert emits.sum() == pytest.approx(lens.sum() + len(lens))
