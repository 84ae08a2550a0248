"""Mined rules may hold tokens of more than half of the labelled urls."""

import itertools
import random

import pytest

from verdant.llm import url_rules as U

from test_url_rules import brute_tokens


def brute_mine(rows, support, confidence, lift):
    """All minimal token sets, of any tokens, by counting."""
    rows = list(set(rows))
    n, n_bad = len(rows), sum(b for _, b in rows)
    sets = [(brute_tokens(u), b) for u, b in rows]
    good = []
    for size in range(1, max(len(s) for s, _ in sets) + 1):
        for c in {c for s, _ in sets for c in itertools.combinations(sorted(s), size)}:
            hits = [b for s, b in sets if set(c) <= s]
            if not any(set(g) < set(c) for g in good) and sum(hits) >= max(support * n, U.MIN_URLS) and \
                    sum(hits) / len(hits) >= confidence and sum(hits) / len(hits) / (n_bad / n) >= lift:
                good.append(c)
    return set(good)


def skewed():
    """'en' and 'blog' are bad together only; https, en and example are in most urls."""
    rnd = random.Random(6)
    rows = []
    for i in range(240):
        lang = rnd.choice(["en", "en", "en", "fr", "de"])
        sub = rnd.choice(["blog", "blog", "m", "www"])
        url = f"{rnd.choice(['https', 'https', 'http'])}://{sub}.site{rnd.randrange(3)}.example.net/{lang}/{i}"
        rows.append((i, url, lang == "en" and sub == "blog" and rnd.random() < 0.95))
    return rows


def bad_host():
    """A bad host of more than half of the labelled pages."""
    return [(i, f"http://{'casino' if i % 5 < 3 else f'good{i % 7}'}.example.net/{'ab'[i % 2]}/{i}", i % 5 < 3) for i in range(100)]


@pytest.mark.parametrize("rows,rule,page", [(skewed(), ("blog", "en"), "https://blog.other.example.net/en/new"),
                                            (bad_host(), ("casino",), "http://casino.example.net/new")])
def test_common_tokens_take_part(spark, rows, rule, page):
    mined = brute_mine([(u, b) for _, u, b in rows], 0.02, 0.6, 1.5)
    assert rule in mined
    labelled = spark.createDataFrame([(u, b) for _, u, b in rows], "url string, bad boolean")
    found = U.mine(labelled, 0.02, 0.6, 1.5).collect()
    everywhere = set.intersection(*(brute_tokens(u) for _, u, _ in rows))
    assert everywhere and {tuple(r.tokens) for r in found} == {c for c in mined if not everywhere & set(c)}
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(999, page)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id bigint, bad boolean")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, 0.02, 0.6, 1.5, rules=()).collect()}
    assert got == {i: "block" if any(set(c) <= brute_tokens(u) for c in mined) else "allow"
                   for i, u in [(i, u) for i, u, _ in rows] + [(999, page)]} and got[999] == "block"


def test_shared_segments_are_one_class(spark):
    """30 segments that six bad urls share, alone and together with others."""
    import time
    long = "/".join(f"s{k}" for k in range(30))
    rows = [(i, f"http://h{i}.net/{long}/{i}", True) for i in range(6)] + [(10 + i, f"http://h{i}.net/ok{i}/x", False) for i in range(34)]
    labelled = spark.createDataFrame([(u, b) for _, u, b in rows], "url string, bad boolean")
    began = time.time()
    rules, members = U.mine_classes(labelled, 0.005, 0.6, 1.5)
    assert [r.classes for r in rules.collect()] == [["s0"]]
    assert sorted(r.token for r in members.where("class = 's0'").collect()) == sorted(f"s{k}" for k in range(30))
    assert {tuple(r.tokens) for r in U.mine(labelled, 0.005, 0.6, 1.5).collect()} == {(f"s{k}",) for k in range(30)}
    assert time.time() - began < 30                         # twelve took minutes before; some of it is Spark's start
    good = spark.createDataFrame([(f"http://q{i}.net/{long}/fine/{i}", False) for i in range(12)]
                                 + [(f"http://q{i}.net/{long}/free/{i}", True) for i in range(8)], "url string, bad boolean")
    rules, members = U.mine_classes(good, 0.005, 0.6, 1.5)
    assert {tuple(r.classes) for r in rules.collect()} == {("free",)}


def test_support_is_an_argument(spark):
    rows = [(f"http://a.net/bad/{i}", True) for i in range(3)] + [(f"http://a.net/x/{i}", False) for i in range(7)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert U.mine(labelled, 0.0, 0.6, 1.5).collect() == []
    assert {tuple(r.tokens) for r in U.mine(labelled, 0.0, 0.6, 1.5, min_urls=3).collect()} == {("bad",)}
