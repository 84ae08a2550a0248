"""Keyword search against brute force, and what its plan holds."""

import random
import re

from verdant.operators import search as S


def _brute(kb, queries, k):
    out = []
    for query, text in queries:
        score = {}
        for doc in {d for d, _, _ in kb}:
            mine = [((t or "").lower(), (c or "").lower()) for d, t, c in kb if d == doc]
            for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()):
                if w:
                    met = sum if len(w) < 3 else any           # short words count once a row
                    score[doc] = score.get(doc, 0) + met(w in c for _, c in mine) + 2 * met(w in t for t, _ in mine)
        ranked = sorted((-s, -1 if d is None else d, d) for d, s in score.items() if s > 0)[:k]
        out += [(query, i + 1, d, -s) for i, (s, _, d) in enumerate(ranked)]
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["a", "ab", "abc", "bca", "Öl", "é", "x" * 70, "cab", "zz z", "be"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "\n", "", "\t"]) for _ in range(n))
    kb = [(i % 50 if i % 11 else None, rnd.choice([None, text(2)]), rnd.choice([None, text(6), text(40)])) for i in range(120)]
    queries = [(i, text(rnd.randint(0, 6))) for i in range(9)] + [(3, "abc"), (100, "x" * 69), (101, "nowhere"), (102, " ")]
    asked = {}
    for q, t in queries:
        asked[q] = asked.get(q, "") + " " + t
    want = _brute(kb, list(asked.items()), 5)
    k = spark.createDataFrame(kb, "doc_id int, title string, content string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, query_text string")
    got = S.keyword_search(k, q, 5)
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(S, "SCORED_ROWS", 3)
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    monkeypatch.setattr(S, "KNOWN_TOKENS", 2)
    assert sorted(map(tuple, S.keyword_search(k, q, 5).collect()), key=str) == want
    assert S.keyword_search(k, q.limit(0), 5).collect() == []


def test_no_table_of_words_and_entries(spark):
    kb = spark.createDataFrame([(1, "t", "some text")], "doc_id int, title string, content string")
    q = spark.createDataFrame([(1, "text so")], "query_id int, query_text string")
    plan = S.keyword_search(kb, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
