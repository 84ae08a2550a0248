"""Spaced seeds against brute force over all alignments."""

import itertools
import random
import re
from collections import Counter

from verdant.llm import decontaminate as D


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    out, at = {}, {}
    for d, t in docs:
        places = at.setdefault((d, t), {})
        for p, x in enumerate(words(t)):
            places.setdefault(x, set()).add(p)
    for (d, t), (i, s) in itertools.product(docs, items):
        w, b = words(t), words(s)
        if not b:
            continue
        n = min(D.WINDOW, len(b))
        few = n // 6 if n >= D.LEAST else 0
        shifts = Counter(p - j for j, x in enumerate(b) for p in at.get((d, t), {}).get(x, ()))
        for shift in (k for k, c in shifts.items() if c >= n - few):
            same = [0 <= shift + j < len(w) and w[shift + j] == b[j] for j in range(len(b))]
            best = max(sum(same[k:k + n]) for k in range(len(b) - n + 1))
            if best >= n - few:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_masks_meet_every_window():
    for n in range(D.LEAST, D.WINDOW + 1):
        for wrong in itertools.combinations(range(n), n // 6):
            assert any(all(at + k not in wrong for k in mask) for mask in D.MASKS for at in range(n - mask[-1]))


def data():
    rnd = random.Random(11)
    voc = [f"w{k}" for k in range(60)] + ["é", "ñandú"]
    items = [(k, " ".join(rnd.choices(voc, k=rnd.choice([1, 3, 5, 7, 8, 9, 11, 12, 13, 30])))) for k in range(25)]
    docs = []
    for k in range(120):
        w = rnd.choices(voc, k=rnd.choice([0, 2, 30, 80]))
        for _ in range(rnd.randrange(3)):
            part = items[rnd.randrange(len(items))][1].split()
            for _ in range(rnd.randrange(4)):
                part[rnd.randrange(len(part))] = rnd.choice(voc)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part[rnd.randrange(3):]
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(w).title()))
    return docs + [(500, None), (501, ""), (7, docs[7][1])], items + [(90, None), (91, ""), (3, items[3][1])]


def test_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id bigint, text string, near string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, seed int")
    got = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(d, i).collect()}
    want = brute(docs, items)
    assert want and got == want
    left = D.clean(d, i)
    bad = {k for k, _ in want}
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(k for k, _ in docs if k not in bad)


def test_short_items_stand_word_by_word(spark):
    docs = [(1, "say: What is the capital of France? Paris"), (2, "what is the big capital of france"), (3, "yes"), (4, "Yes, and no"), (5, "the")]
    items = [(10, "What is the capital of France?"), (11, "YES"), (12, "and no more"), (13, "of")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(d, i).collect()}
    assert got == {(1, 10): 6, (3, 11): 1, (4, 11): 1, (1, 13): 1, (2, 13): 1} == brute(docs, items)


def test_a_full_filter_costs_rows_not_results(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_WORDS", 1)
    docs, items = data()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id): r.matched for r in D.overlaps(d, i).collect()} == brute(docs, items)
    plan = D.overlaps(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan and "BatchEvalPython" not in plan


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert D.overlaps(d, i).collect() == [] and D.clean(d, i).count() == 1
    assert D.overlaps(d.limit(0), i).collect() == []
