"""Expectation-maximisation on simulated labellers, and held-out accuracy of the classifier."""

import random

import numpy as np

from verdant.llm import quality as Q

INSULTS = ["moron", "scum", "clown"]


def test_em_recovers_labeller_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.2
    acc = [(0.9, 0.02), (0.7, 0.05), (0.8, 0.1), (0.6, 0.01)]
    votes = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in acc], axis=1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = Q.expectation_maximisation(patterns, counts)
    assert abs(prior - 0.2) < 0.03
    for k, (a, b) in enumerate(acc):
        assert abs(table[k, 1, 1] / (1 - table[k, 1, 2]) - a) < 0.06 and abs(table[k, 0, 1] / (1 - table[k, 0, 2]) - b) < 0.03
    q = Q.posterior(votes, prior, table)
    assert ((q > 0.5) == y).mean() > 0.95


def corpus():
    rnd = random.Random(9)
    voc = ["".join(rnd.choices("abcdefghimnorst", k=rnd.randrange(2, 9))) for _ in range(700)]
    rows = []
    for i in range(900):
        w = rnd.choices(voc, k=rnd.randrange(40, 200))
        kind = i % 9
        if kind == 0:
            w = [x + rnd.choice(["%%%", "&&&"]) for x in w]
        elif kind == 1:
            w = [x for y in w for x in (y, "|")]
        elif kind == 2:
            w = [x for y in w[:9] for x in [y] * 30]
        elif kind == 3:
            w = [x.upper() + "!!" for x in w]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(INSULTS))
        rows.append((i, " ".join(w), int(kind < 4), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows], "doc_id bigint, text string, keep int")
    labels = spark.createDataFrame([(i, 1 - j, x) for i, _, j, x in rows if i % 2 == 0] + [(4, None, None), (77777, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    model = Q.train(docs, labels)
    assert len(model.lexicon) >= len(INSULTS)
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert len(got) == len(rows) and got[0].keep == 1
    held = [(got[i], j, x) for i, _, j, x in rows if i % 2]
    assert sum((r.p_junk > 0.5) == bool(j) for r, j, _ in held) / len(held) > 0.97
    assert sum((r.p_toxic > 0.5) == bool(x) for r, _, x in held) / len(held) > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "x" * 20000)],
                                 "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = Q.train(docs, none)
    out = Q.judge(docs, model).collect()
    assert len(out) == 5 and all(r.keep for r in out)
    assert Q.judge(docs.limit(0), Q.train(docs.limit(0), none)).collect() == []


def test_given_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.judge(docs.select("doc_id", "text"), Q.train(docs, labels)).join(labels, "doc_id").collect()
    assert sum((r.p_junk > 0.5) == (r.quality == 0) for r in rows) / len(rows) > 0.98
    assert sum((r.p_toxic > 0.5) == (r.toxic == 1) for r in rows) / len(rows) > 0.94
    assert all(r.p_toxic < 0.5 for r in rows if r.toxic == 0)


def test_counts_and_posteriors_by_brute_force(spark):
    """Tokens of every labelled document by class and fold, vote patterns over all documents, and their posteriors."""
    from collections import Counter
    import pyarrow as pa
    from pyspark.sql import functions as F
    rows = corpus()[:300]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(7, rows[7][1])], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - j, x) for i, _, j, x in rows if i % 3], "doc_id bigint, quality int, toxic int")
    gold = Q._gold(labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(Q.FOLDS)).cast("int"))
    found = Q.labelled_documents(docs, gold)
    kept = {r.doc_id: r for r in found.collect()}
    assert len(kept) > 0.9 * 200 and all(i % 3 for i in kept)               # few words: some share a smallest pair
    assert found.count() == len(kept)                                       # 7 stands twice and counts once
    reading = {i: set(Q.read(pa.array([t])).token.view(np.int64).tolist()) for i, t, _, _ in rows}
    want = Counter()
    for i, r in kept.items():
        for tok in reading[i]:
            for t in Q.TARGETS:
                want[tok, f"n_{t}{r.fold}"] += 1
                want[tok, f"yes_{t}{r.fold}"] += r[f"gold_{t}"]
    got = Counter()
    for r in Q.token_counts(docs, found).collect():
        for c, v in r.asDict().items():
            if c != "token" and v:
                got[r.token, c] = v
    assert got == +want
    model = Q.train(docs, labels)
    patterns, counts = np.unique(np.array([[1, 0], [1, -1], [0, 0], [-1, 1]], np.int8), axis=0, return_counts=True)
    prior, table = 0.3, np.array([[[.7, .1, .2], [.1, .8, .1]], [[.6, .2, .2], [.3, .4, .3]]])
    for p, q in zip(patterns, Q.posterior(patterns, prior, table)):
        like = [np.prod([table[k, y, p[k] if p[k] >= 0 else 2] for k in range(2)]) for y in (0, 1)]
        assert abs(q - prior * like[1] / (prior * like[1] + (1 - prior) * like[0])) < 1e-9
    total = sum(tab[0] >= 0 for tab in model.accuracies.values())
    assert total == 2 and len(model.lexicon) >= len(INSULTS)
