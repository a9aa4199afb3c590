"""Hypergeometric draws of any size; packing against plain best fit decreasing."""

import math
from decimal import localcontext

import numpy as np
import pytest

from tidemark.llm.packing import best_fit, cut, pack
from tidemark.llm.sharding import _draw, _log_factorial, _log_weight, hypergeometric


def test_log_factorial_and_weights():
    with localcontext() as c:
        c.prec = 50
        for n in (1000, 5000):
            assert abs(_log_factorial(n) - c.create_decimal(math.factorial(n)).ln()) < 1e-30
        ratio = _log_weight(40, 90, 200, 100) - _log_weight(31, 90, 200, 100)
        exact = math.comb(90, 40) * math.comb(200, 60) / (math.comb(90, 31) * math.comb(200, 69))
        assert math.isclose(float(ratio.exp()), exact, rel_tol=1e-12)


@pytest.mark.parametrize("good, bad, n", [(30, 50, 40), (500, 20, 100), (3, 400, 200), (1000, 1000, 1990), (7, 9, 5)])
def test_draws_follow_the_law(good, bad, n):
    rng, draws = np.random.default_rng(1), 4000
    got = np.bincount([hypergeometric(rng, good, bad, n) for _ in range(draws)], minlength=n + 1)
    pmf = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)])
    assert got[pmf == 0].sum() == 0
    often = pmf * draws >= 5
    chi = (((got - pmf * draws) ** 2)[often] / (pmf * draws)[often]).sum()
    free = often.sum()
    assert chi < free + 5 * math.sqrt(2 * free)


def test_draws_beyond_numpy():
    rng, good, bad, n = np.random.default_rng(2), 3 * 10**12, 9 * 10**12, 10**11
    mean = n * good / (good + bad)
    deviation = math.sqrt(mean * (bad / (good + bad)) * (good + bad - n) / (good + bad - 1))
    z = np.array([(hypergeometric(rng, good, bad, n) - mean) / deviation for _ in range(1500)])
    assert abs(z.mean()) < 0.13 and abs(z.std() - 1) < 0.1 and abs((z**3).mean()) < 0.4
    counts = np.full(16, 5 * 10**9, np.int64)
    row = _draw(rng, counts, 10**10)
    assert row.sum() == 10**10 and (row >= 0).all() and (row <= counts).all()


def test_packing_is_never_above_best_fit_decreasing(spark):
    rng = np.random.default_rng(3)
    words = ["alpha ", "beta, ", "gamma-rays ", "x1 "]
    docs = spark.createDataFrame([(i, "".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(5, 900, 4000))],
                                 "doc_id long, text string")
    pieces = cut(docs, capacity=1024)
    placed = pack(pieces, capacity=1024)
    rows = placed.select("uid", "length", "sequence_id", "offset").collect()
    loose = [r.length for r in rows if r.length < 1024]
    plain = best_fit([], sorted(range(len(loose)), key=lambda p: -loose[p]), loose, 1024)
    full = sum(r.length == 1024 for r in rows)
    assert len({r.sequence_id for r in rows}) <= len(plain) + full
    assert len({r.uid for r in rows}) == len(rows) == pieces.count()
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert at[r.sequence_id] <= 1024
