"""Stated and mined URL rules against brute force."""

import itertools
import random
import re

from verdant.llm import url_rules as U


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [r for r in U.STATED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def brute_tokens(url):
    return set(re.findall(r"[^\W_]+", (url or "").lower()))


def brute_mine(rows, support, confidence, lift):
    """All token sets of up to three tokens by counting."""
    rows = list(set(rows))
    n, n_bad = len(rows), sum(b for _, b in rows)
    sets = [(brute_tokens(u), b) for u, b in rows]
    common = {t for s, _ in sets for t in s if 2 * sum(t in x for x, _ in sets) > n}
    sets = [(s - common, b) for s, b in sets]
    good = []
    for size in (1, 2, 3):
        seen = {c for s, _ in sets for c in itertools.combinations(sorted(s), size)}
        for c in seen:
            if any(set(g) < set(c) for g in good):
                continue
            hits = [b for s, b in sets if set(c) <= s]
            if sum(hits) >= max(support * n, U.MIN_URLS) and sum(hits) / len(hits) >= confidence and \
                    sum(hits) / len(hits) / (n_bad / n) >= lift:
                good.append(c)
    return set(good)


def data():
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        host = rnd.choice(["win.example.net", "ads.shop.net", "www.example.org", "Example.COM", "blog.a.com"])
        path = rnd.choice(["/en/1", "/es/x", "/fr/2", "/de/3", "", "/free/bets", "/free/books"])
        rows.append((i, f"http://{host}{path}" + rnd.choice(["", "?free=1", "#top"])))
    rows += [(900, None), (901, "no scheme free"), (902, "://"), (903, "x://ORG/"), (904, "http://example.org/en/1?x"),
             (905, "http://badexample.org/en/1"), (906, "http://org"), (907, rows[0][1]), (907, rows[0][1]), (None, "http://q.net/free/bets")]
    labels = [(i, "bets" in (u or "") or ("ads" in u and "free" in u)) for i, u in rows[:250]] + [(5, None), (7, True), (8888, True)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = data()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, host string")
    lab = spark.createDataFrame(labels, "page_id bigint, bad boolean")
    by_id = {i: u for i, u in rows if i is not None}
    mined = brute_mine([(by_id[i], b) for i, b in labels if b is not None and i in by_id], 0.02, 0.8, 1.5)
    assert mined
    got = U.judge(pages, lab, 0.02, 0.8, 1.5).collect()
    assert len(got) == len(rows)
    urls = {}
    for i, u in rows:
        urls.setdefault(i, u)
    for r in got:
        u = urls[r.page_id]
        host, path = brute_host_path(u)
        rule = brute_rule(host, path)
        assert (r.host, r.path) == (host, path) and r.rule == (rule.text if rule else None)
        hit = any(set(c) <= brute_tokens(u) for c in mined)
        assert r.verdict == (rule.verdict if rule else ("block" if hit else "allow"))


def test_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    assert [r.verdict for r in U.judge(pages, none).collect()] == ["allow"]
    assert U.judge(pages.limit(0), none).collect() == []


def test_stated_rules_are_those_of_the_contract(spark):
    assert [(r.verdict, r.text) for r in U.STATED] == [
        ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    pages = spark.createDataFrame([(1, "http://www.example.org/es/x"), (2, "http://example.org/es"), (3, "http://a.org/es/x")],
                                  "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, none).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("org/", "allow")}
