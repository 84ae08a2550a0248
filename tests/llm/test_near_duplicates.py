"""The pipeline's near-duplicate stage against all pairs: five words, similarity 0.8."""

import random

import corpus_pipeline as C
from verdant.llm import jaccard_join as J


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows):
    """Ids that are the smallest of their component."""
    sets = {d: shingles(t) for d, t in rows}
    low = {d: d for d in sets}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return sorted(d for d in sets if find(d) == d)


def corpus():
    rnd = random.Random(8)

    def words(n):
        return [f"w{rnd.randrange(10 ** 9)}" for _ in range(n)]

    long, spread, whole = words(400), words(365), words(8)
    texts = [long, long[:332],                                    # 0.828 of five words, 0.829 of four
             long[:320], long[:310],                              # linked and not linked to the first
             spread, [f"s{k}" if k % 45 == 20 and k < 365 else w for k, w in enumerate(spread)],
             whole + words(1), whole[:8], whole[:7]]              # sets of 5, 4 and 3 shingles
    for n in (5, 8, 9, 12, 30, 60, 100, 200):
        for _ in range(6):
            base = words(n)
            texts += [base, base[:max(1, n - rnd.randrange(n // 4 + 1))], words(rnd.randrange(n // 4 + 1)) + base]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def test_stage_takes_five_words_and_four_fifths(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(r.doc_id for r in C.keep_one_of_each(spark, docs, "").collect())
    assert 1 not in kept and 5 not in kept and 7 not in kept       # lost tail, scattered edits, 4 shingles of 5
    assert kept == brute(rows)


def test_small_sets_follow_from_the_similarity():
    assert J.CONTRACT == J.Likeness(4, 85, 100) and J.CONTRACT.least == 6 and C.NEAR.least == 4
    for like in (J.CONTRACT, C.NEAR, J.Likeness(3, 2, 3)):
        pairs = [n for n in range(1, 60) if like.den * n >= like.num * (n + 1)]      # n of n + 1 shingles
        assert like.least == pairs[0]
