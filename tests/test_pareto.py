"""The frontier over many Sharpe ranges against one walk down the ranking."""

import random

import pytest

from verdant.operators import screen as S


@pytest.mark.parametrize("by", [None, "sector"])
def test_ranges_carry_the_best_above(spark, by):
    rnd = random.Random(12)
    rows = [(f"S{k:03d}", rnd.choice([None, *(round(rnd.uniform(0, 3), 1) for _ in range(9))]), rnd.choice([None, *(float(rnd.randrange(60)) for _ in range(9))]))
            for k in range(300)]
    sector = {r[0]: rnd.choice(["A", "B", None]) for r in rows}
    metrics = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "symbol string, sharpe_252d double, avg_esg_composite double, as_of_date string")
    companies = spark.createDataFrame([(s, s.lower(), g, False, False) for s, g in sector.items()],
                                      "symbol string, name string, sector string, restricted_business boolean, severe_controversy boolean")
    want = set()
    for group in {sector[r[0]] if by else 0 for r in rows}:
        best = -1.0
        mine = [r for r in rows if r[1] is not None and r[2] is not None and (not by or sector[r[0]] == group)]
        for s, _, esg in sorted(mine, key=lambda r: (-r[1], -r[2], r[0])):
            if esg > best:
                best = esg
                want.add(s)
    for range_rows in (7, 60, 10 ** 6):
        got = S.pareto_all(metrics, companies, by=by, range_rows=range_rows)
        assert {r.symbol for r in got.collect()} == want
