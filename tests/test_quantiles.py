"""Quantiles by sketched brackets against sorted values."""

import math

import numpy as np
import pytest

from steadymark.operators import quantiles
from steadymark.operators.ordered import exact_quantiles, ranked_values
from steadymark.operators.quantiles import sketched_quantiles

SHARES = [0.5, 0.25, 0.75, 0.0, 1.0, 0.001]


@pytest.fixture(scope="module")
def values(spark):
    """Columns without ties, with one value in a third of the rows, with few values, with NaN, and without values."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(20_000):
        hot = 7.5 if i % 3 == 0 else float(rng.normal() * 10)
        rows.append((float(rng.normal()), hot, float(rng.integers(0, 4)), float("nan") if i % 5 == 0 else float(i), None, None if i % 2 else float(i)))
    schema = "a double, hot double, few double, nan double, none double, half double"
    return spark.createDataFrame(rows, schema).repartition(7).cache()


def expected(rows, column):
    known = sorted((r[column] for r in rows if r[column] is not None), key=lambda v: (v != v, v))
    return [known[max(1, math.ceil(len(known) * p)) - 1] if known else None for p in SHARES]


@pytest.mark.parametrize("small", [1 << 17, 300, 0])
def test_equal_to_sorted_values(values, small):
    rows = values.collect()
    got = {r["feature"]: list(r)[1:] for r in sketched_quantiles(values, values.columns, SHARES, small).collect()}
    for column in values.columns:
        for a, b in zip(got[column], expected(rows, column)):
            assert a == b or (a != a and b != b)


def test_a_wrong_bracket_is_noticed(values, monkeypatch):
    """With a margin that is far too small brackets miss their target, and are widened."""
    missed = []
    settle = quantiles._Bracket.settle

    def watched(self, below, inside, *rest):
        missed.append(not below < self.target <= below + inside)
        return settle(self, below, inside, *rest)

    monkeypatch.setattr(quantiles._Bracket, "settle", watched)
    monkeypatch.setattr(quantiles, "MARGIN", 1e-5)
    monkeypatch.setattr(quantiles, "SKETCH", 100)
    rows = values.collect()
    got = {r["feature"]: list(r)[1:] for r in sketched_quantiles(values, ["a", "hot"], SHARES, 50).collect()}
    assert got["a"] == expected(rows, "a") and got["hot"] == expected(rows, "hot") and any(missed)


def test_equal_to_the_quantiles_of_ranks(values):
    ranked = exact_quantiles(ranked_values(values.selectExpr("a", "hot", "1 AS t"), ["a", "hot"], "t"), SHARES)
    assert sorted(map(tuple, sketched_quantiles(values, ["a", "hot"], SHARES, 500).collect())) == sorted(map(tuple, ranked.collect()))


def test_no_rows(spark):
    got = sketched_quantiles(spark.createDataFrame([], "a double"), ["a"], SHARES).collect()
    assert [list(r) for r in got] == [["a"] + [None] * len(SHARES)]
