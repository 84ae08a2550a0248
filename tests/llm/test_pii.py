"""Base spans against the plain patterns, message passing against enumeration, and the label consistency it brings."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from verdant.llm import pii as P

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def checked(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        double = [d * 2 if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(sum(map(int, str(d))) for d in double) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if checked(k, m.group())]


def messy(rnd):
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "1.2.3.4", "255.255.255.256", "010.0.00.1", "a.b@c.d-e.f",
             "@x.y", "a@b.c@d.e.", "+1 (614) 555-8001", "+49.30.1234567", "++1234567-8", "x", "é", "@", ".", "-", " ", "\n", "(", ")", "7",
             "12345678901234567890", "A%+", "日本", "1.2.3.4.5.6.7.8", "a@b", "0" * 17]
    return "".join(rnd.choice(parts) + rnd.choice(["", "", " ", "."]) for _ in range(rnd.randrange(25)))


def test_base_patterns():
    rnd = random.Random(8)
    for _ in range(4000):
        t = messy(rnd)
        assert sorted(P.base_spans(t)[0]) == sorted(plain(t)), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "+" + " " * 300_000, "1 " * 150_000):
        P.base_spans(t)


def test_marginals_on_a_tree_are_exact():
    rng = np.random.default_rng(0)
    k = len(P.LABELS)
    sym = rng.normal(size=(k, k))
    field = P.Field({P.cell_of("s"): np.log(rng.dirichlet(np.ones(k)))}, rng.normal(size=k), rng.normal(size=(k, k)), sym + sym.T)
    t = P.Tokens([(3 * i, 3 * i + 2) for i in range(4)], [-1, -1, 2, -1], ["s", "u", "s", "u"], [True, False, False, False],
                 [["p"], [], ["p"], ["q"]])
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        if y[2] != 2:
            continue
        e = sum(field.shapes.get(P.cell_of(t.shape[i]), field.unseen)[y[i]] for i in (0, 1, 3))
        e += field.chain[y[0], y[1]] + field.skip[y[0], y[2]]
        e += field.chain[0, y[0]] + field.chain[y[1], 0] + field.chain[0, y[2]] + field.chain[y[2], 0] + field.chain[0, y[3]] + field.chain[y[3], 0]
        for i in range(4):
            want[i, y[i]] += np.exp(e)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(P.marginals(t, field), want, atol=1e-6)


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        num = f"{rnd.randrange(200, 999)} {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
        t = f"word {rnd.randrange(10 ** 4)} text, call +1 {num} or mail u{i}@h{i % 5}.example.com now"
        if i % 3 == 0:
            t += f". Again +1 {num}, and {10 ** 11 + rnd.randrange(10 ** 11)} items"
        rows.append((i, t))
    return rows


def test_repeated_numbers_take_the_label_of_their_full_form(spark):
    rows = corpus()
    special = "Reach +1 6145558001 today. " + "filler words " * 40 + "or 6145558001 at night; order 7145558002."
    rows += [(1000, special), (1001, None), (1002, ""), (1003, "plain"), (1000, special), (None, "1.2.3.4 and x@y.z")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, spans string")
    out = P.digest(df).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        text = texts[r.doc_id] or ""
        base = sorted(plain(text))
        written = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert {x for x in written.split(",") if x} <= set(r.spans.split(","))
    at = special.rindex("6145558001")
    spans = next(r.spans for r in out if r.doc_id == 1000)
    assert f"phone:{at}:{at + 10}" in spans and str(special.index("7145558002")) not in spans


def test_mask(spark):
    df = spark.createDataFrame([(1, "to a@b.co, 1.2.3.4!", 5), (2, None, 6)], "doc_id bigint, text string, n int")
    out = {r.doc_id: r for r in P.mask(df, P.train(df)).collect()}
    assert out[1].text == "to [EMAIL], [IP]!" and out[2].text is None and out[1].n == 5
    assert P.digest(df.limit(0)).collect() == []


@pytest.mark.parametrize("token,shape", [("(614)", "(d3)"), ("and5", "ad1"), ("u7@x.com", "ad1@a.a")])
def test_shapes(token, shape):
    assert P.shape_of(token) == shape


def test_numbers_in_parts_share_keys():
    text = "Call +1 614 555 8001 today. Again: 614 555 8001, or (614) 555 8001; 555 8001 too, not 555 8002 nor 2019 2020"
    t = P.read_tokens(text, *P.base_spans(text))
    words = [text[s:e] for s, e in t.span]
    by = {}
    for w, keys in zip(words, t.keys):
        for k in keys:
            by.setdefault(k, []).append(w)
    assert by["6145558001"] == ["+1", "614", "555", "8001", "8001", "8001"]          # the full form, then each repeat
    assert len(by["5558001"]) == 7 and by["5558002"] == ["8002"] and "2020" not in by
    assert sum(words[i] == words[j] == "8001" for i, j in P.skip_links(t)) >= 3


def test_spaced_repeat_takes_the_label_of_its_full_form(spark):
    special = "Reach +1 614 555 8001 today. " + "filler words " * 40 + "or 614 555 8001 at night; order 714 556 8002."
    df = spark.createDataFrame([*corpus(), (1000, special)], "doc_id bigint, text string")
    spans = next(r.spans for r in P.find(df, P.train(df)).collect() if r.doc_id == 1000)
    at = special.rindex("614 555 8001")
    assert f"phone:{at}:{at + 12}" in spans and str(special.index("8002") + 4) not in spans


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 5, "x", "y")], "doc_id bigint, text string, n_email int, spans string, Base_Spans string")
    field = P.train(df)
    out = P.find(df, field)
    assert out.columns == ["doc_id", "n_email", "spans", "Base_Spans", "n_email_", "n_ip", "n_card", "n_phone", "base_spans_", "spans_"]
    r = out.first()
    assert (r.n_email, r.n_email_, r.spans, r.spans_) == (5, 1, "x", "email:5:11")
    assert P.mask(df, field).first().text == "mail [EMAIL]"
