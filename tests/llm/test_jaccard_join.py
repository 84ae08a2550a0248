"""Heavy-light join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from verdant.llm import jaccard_join as J


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for sep in "\t\n\x0b\x0c\r":
        t = t.replace(sep, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), low.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
    return w


def corpus(seed):
    rnd = random.Random(seed)
    voc = [f"v{k}" for k in range(400)]
    passages = [rnd.choices(voc, k=60) for _ in range(3)]
    texts = []
    for _ in range(60):
        w = rnd.choices(voc, k=rnd.choice([1, 2, 3, 4, 8, 9, 10, 12, 14, 20, 40, 120, 400]))
        texts.append(w)
        for _ in range(rnd.randrange(5)):
            texts.append(edited(rnd, w, rnd.choice([0, 0, 1, 1, 2, 3])))
    for _ in range(30):                                    # shared passages, otherwise unlike
        texts.append(rnd.choices(voc, k=80) + rnd.choice(passages))
        texts.append(sum(rnd.sample(passages, 2), []) + rnd.choices(voc, k=rnd.randrange(12)))
    base = rnd.choices(voc, k=150)
    texts += [edited(rnd, base, rnd.choice([1, 2, 3, 4])) for _ in range(80)]     # a large group, some pairs below 0.85
    w = rnd.choices(voc, k=100)
    for k in range(12):                                    # a chain
        texts.append(list(w))
        w = edited(rnd, w, 1)
    rows = [(3 * k + 5, " ".join(t).upper() if k % 9 == 0 else "\t".join(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (rows[4][0], rows[4][1]), (None, rows[5][1]), (None, "only me here now")]


@pytest.mark.parametrize("seed,stretch,light", [(1, 2000, None), (2, 10 ** 6, 30)])
def test_against_all_pairs(spark, monkeypatch, seed, stretch, light):
    monkeypatch.setattr(J, "STRETCH", stretch)
    if light:
        monkeypatch.setattr(J, "boundary", lambda *_: light)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, class int").repartition(3)
    out = J.join(df).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, (r.component_id if r.component_id is not None else -1))
                 for r in out)
    assert got == brute(rows)
    kept = J.keep_one(df)
    ids = sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect())
    assert kept.columns == df.columns and ids == sorted({c for d, _, c in got if d == c and c >= 0})


def test_blocks_and_short_lists(spark, monkeypatch):
    """Long lists compared block by block, lists of two as pairs at once."""
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "SHORT_LIST", 2)
    rows = corpus(5)
    out = J.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in out) == brute(rows)


def test_repeated_and_missing_ids_lose_no_clean_text(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, 7), (1, b, 8), (2, a + " end", 9), (3, b, 1), (3, b, 1), (4, "c d e f g", 0), (4, "c d e f g", 0),
            (None, a, 2), (None, "only here and nowhere else", 3), (None, "only here and nowhere else", 4), (5, "", 5), (5, "", 5), (6, None, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (1, b), (4, "c d e f g"), (0, "only here and nowhere else"), (5, ""), (5, ""), (6, "")])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert J.join(df).collect() == [] and J.keep_one(df).collect() == []


def test_boundary_follows_cost():
    assert J.boundary({8: 1000, 300: 1000}, 50.0) > J.boundary({8: 1000, 300: 1000}, 0.0) or J.boundary({8: 10}, 0.0) >= 5
    assert J.boundary({}, 1.0) == J.LEAST - 1
