"""Ball assignment against comparing all entries, and the digest against a plain reading of the contract."""

import hashlib
import math
import random

import numpy as np
import pytest

from verdant.llm import ball_codes


@pytest.mark.parametrize("scale", [3, 40, 1000, 1 << 24])
def test_balls_find_the_nearest(scale):
    rng = np.random.default_rng(scale)
    centres = rng.integers(-scale, scale + 1, (12, 5))
    x = np.concatenate([c + rng.integers(-scale // 20 - 1, scale // 20 + 2, (80, 5)) for c in centres] + [rng.integers(-scale, scale + 1, (200, 5))])
    old = x[rng.permutation(len(x))[:40]]
    before, _ = ball_codes.nearest(x, old)
    book = np.concatenate([old[:20] + rng.integers(-1, 2, (20, 5)), old[20:35], old[30:35]])    # with equal entries
    codes, error, looked = ball_codes.nearest_in_balls(x, book, before)
    full = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (codes == full.argmin(1)).all() and (error == full.min(1)).all()
    assert (ball_codes.distances(x, book) == full).all()
    if scale > 3:
        assert looked < 0.6 * full.size                                    # cores and rings spare comparisons


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(cut(v, p), b), e) for e, b in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(kept[i][1], p) for i in range(len(kept)) if got[i][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for v in b for x in v).encode()).hexdigest()
    errors = [sum(x for x, _ in g) for g in got]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in g), x, by_label[lab], sha) for (i, _, lab), g, x in zip(kept, got, errors)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"
key = lambda r: tuple((x is None, x) for x in r)


def test_digest_equals_brute_force(spark):
    rnd = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rnd.gauss(c, 0.1)) for c in (0.2, -0.3) * 4], rnd.choice([0, 1, 1, 1, None])) for i in rnd.sample(range(5000), 330)]
    rows += [rows[0], rows[0], (7000, None, 1), (7001, [], 1), (7002, [float("nan")] * 8, 1), (7003, [float("inf")] + [0.0] * 7, 0),
             (7004, [None] + [0.5] * 7, 0), (None, [0.25] * 8, None), (-5, [0.0] * 8, 3), (-5, [0.0] * 7 + [-1.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = ball_codes.digest(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute(rows), key=key)


def test_few_rows_other_dimensions_and_clashes(spark):
    rows = [(1, [0.5, 0.25, 1.0, 0.0], None), (2, [0.5, 0.5, 0.5, 0.5], 2), (3, [1.0, 2.0], 2), (4, [1e9, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "1 as code", "2 as ints", "3 as error", "4 as dim")
    assert sorted(tuple(r) for r in ball_codes.digest(wide).collect()) == sorted(brute(rows[:2]))
    assert ball_codes.digest(df.limit(0)).collect() == []
    assert ball_codes.digest(df.where("vec_id > 100")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    coded, books = ball_codes.fit(df, parts=3, entries=1, rounds=1)             # parts of 2, 1 and 1 components
    assert [b.shape for b in books] == [(1, 2), (1, 1), (1, 1)] and {len(r.code) for r in coded.collect()} == {3}
    with pytest.raises(ValueError):
        ball_codes.fit(df, entries=300)
