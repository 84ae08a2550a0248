"""Runs against brute force over all lags, and the contract's digest over a plain reading of it."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from verdant.llm import periodic_runs


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i - p] for i in range(p, len(w))))


def brute(w, least=24, times=3):
    out = []
    for p in range(1, len(w) // times + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            s, n = i - p, j - i + p
            if n >= max(least, times * p) and smallest_period(w[s:s + n]) == p:
                out.append((s, n, p))
            i = j
    return sorted(out)


def sequences():
    rnd = random.Random(3)
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 700, list("ab") * 60, list("aab") * 40 + list("ab") * 30]
    for _ in range(60):
        w = [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(1, 4)):
            block = [rnd.choice("abcxyz") for _ in range(rnd.choice([1, 2, 5, 9, 17, 25, 40, 64]))]
            w += (block * rnd.randrange(2, 8))[:rnd.randrange(20, 260)]
            w += [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 9))]
        out.append(w)
    for _ in range(20):
        out.append([rnd.choice("ab") for _ in range(rnd.randrange(30, 200))])
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    thue = [0]
    while len(thue) < 512:
        thue += [1 - t for t in thue]
    return out + [fib[1], [str(t) for t in thue] * 3, [str(t) for t in thue[:64]] * 7 + ["z"] + [str(t) for t in thue[:64]] * 4]


def test_all_runs_of_many_sequences():
    texts = sequences()
    _, runs = periodic_runs.runs_of([" ".join(w) for w in texts])
    assert sum(map(len, runs)) > 60
    for w, got in zip(texts, runs):
        assert sorted(got) == brute(w), w


def test_other_lengths_and_repeats():
    for w in sequences()[6:30]:
        for least, times in ((8, 3), (40, 4), (70, 3), (10, 7)):
            _, (got,) = periodic_runs.runs_of([" ".join(w)], least, times)
            assert sorted(got) == brute(w, least, times), (least, times, w)


def test_splitting_leaves_only_segments_of_frequent_words():
    ids = np.array([0, 1] * 20 + [7] + [2, 3, 4] * 10 + [8, 9] + [0, 1] * 5)
    got = periodic_runs.stable_segments(ids, np.array([0]), np.array([len(ids)]), 24, 3)
    assert got == [(0, 40), (41, 71)]
    assert periodic_runs.stable_segments(np.arange(500), np.array([0]), np.array([500]), 24, 3) == []


def test_long_uniform_text_is_scanned_fast():
    w = ["x"] * 120_000 + ["y"] + [f"w{i % 20_000}" for i in range(70_000)]
    _, (got,) = periodic_runs.runs_of([" ".join(w)])
    assert got == [(0, 120_000, 1), (120_001, 70_000, 20_000)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_digest_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(w)) for i, w in enumerate(sequences())]
    rows += [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 300)))) for i in range(1000, 1060)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n "), (2003, "é x " * 40), (2003, "é x " * 40), (2004, "a\x1cb c d " * 30),
             (None, "p q r " * 20), (None, None), (2005, "one\x0btwo\x0cthree\r\n" * 12), (-7, "u v " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in periodic_runs.digest(df).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert sum(1 for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0) > 8


def test_columns_pass_and_clash(spark):
    df = spark.createDataFrame([(1, "a b " * 20, 5, "x")], "doc_id bigint, text string, RUNS int, collapsed string")
    out = periodic_runs.find(df)
    assert out.columns == ["doc_id", "text", "RUNS", "collapsed", "runs_", "collapsed_"]
    r = out.first()
    assert (r.RUNS, r.collapsed, r.collapsed_, [tuple(x) for x in r.runs_]) == (5, "x", "a b", [(0, 40, 2)])
    assert periodic_runs.digest(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find(df, times=2)
