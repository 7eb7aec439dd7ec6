"""Cases that earlier versions got wrong: texts that ended the JVM, items without words, targets that cannot be met."""

from __future__ import annotations

import numpy as np
import pytest
from brute import frame

from finquery.llm import mixing as MX
from finquery.llm.template_decontam import leaks

STRETCHES = {"one_to_one": False, "stretches": True}


def test_long_runs_of_numbers_and_marks(spark):
    """A megabyte of what a pattern repeats over."""
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank today"
    texts = ["1,2,3," * 170_000, "1.1.1" * 200_000, "1,000,000.00 " * 80_000, "Aa" * 500_000, "Ab " * 330_000, "-" * 1_000_000, " " * 1_000_000 + item, "\u0001\u0002\u0003" * 330_000, "km " * 300_000, "5 km" * 250_000]
    got = leaks(spark, frame(spark, list(enumerate(texts))), frame(spark, [(1, item)]).withColumnRenamed("doc_id", "item_id"), **STRETCHES).collect()
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in got} == {(6, 1, True)}


@pytest.mark.parametrize("options", [{}, STRETCHES])
def test_items_almost_without_words_match_with_their_values(spark, options):
    items = [(1, "Compute 12 + 30 - 4 km"), (2, "Solve x: 3 x 4 = 12"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "42"), (5, "7 km")]
    docs = [(1, "so then. Compute 12 + 30 - 4 km. And"), (2, "Compute 12 + 31 - 4 km"), (3, "please solve x: 3 x 4 = 12 now"), (4, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (5, "1 2 3 4 5 6 7 8 9 10 11 13"), (6, "42 and 7 km")]
    got = leaks(spark, frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"), **options).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (4, 3)} and all(r["verbatim"] for r in got)


def least_squares(p, n, goal):
    """Accelerated projected gradient on the rates, long enough to settle."""
    a = (p * n[:, None]).T / n.sum()
    r = y = np.ones(len(n))
    t, steep = 1.0, np.linalg.eigvalsh((a / n) @ a.T * n.sum())[-1]
    for _ in range(20000):
        new = np.maximum(0, y - p @ (a @ y - goal) / steep)
        t, old = (1.0, 1.0) if ((y - new) * (new - r)).sum() > 0 else ((1 + (1 + 4 * t * t) ** 0.5) / 2, t)
        y, r = new + (old - 1) / t * (new - r), new
    return a @ r


@pytest.mark.parametrize(("seed", "goal"), [(0, (0.9, 0.02, 0.01)), (1, (0.2, 0.5, 0.1)), (2, (0.3, 0.3, 0.35)), (3, (1.5, 0.0, 0.0)), (4, (0.0, 0.0, 0.0))])
def test_nearest_totals_are_the_least_squares(spark, seed, goal):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([6, 3, 2], 80)
    n = rng.integers(1, 500, 80).astype(float)
    table = spark.createDataFrame([(float(m), *map(float, x)) for m, x in zip(n, p, strict=True)], "n_tokens double, p_clean double, p_low double, p_toxic double")
    assert MX.nearest(table, list(goal)) == pytest.approx(least_squares(p, n, np.array(goal)), abs=1e-4)


def test_unreachable_targets_cost_no_more_than_least_squares(spark):
    docs, labels = frame(spark, [(k, ("good words here " if k % 3 else "good bad words ") * 5) for k in range(90)]), spark.createDataFrame([(k, k % 3 and 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no rates meet"):
        r = MX.mixed_rates(spark, docs, labels, targets={"clean": 1.1, "low": 0.0, "toxic": 3.0}).toPandas()
    p, n = r[["p_clean", "p_low", "p_toxic"]].to_numpy(), r.n_tokens.to_numpy(float)
    share = (p * n[:, None]).sum(axis=0) / n.sum()
    got = (p * (n * r.rate.to_numpy())[:, None]).sum(axis=0) / n.sum()
    assert got == pytest.approx(least_squares(p, n, share * [1.1, 0.0, 3.0]), abs=2e-3)
