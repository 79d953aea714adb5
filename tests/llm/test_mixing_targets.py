"""Mixing rates reach their targets where the domains overlap."""

import numpy as np
import pytest

from pagelattice.llm import mixing


@pytest.mark.parametrize("sharpness", [1.0, 2.5])
def test_rates_reach_the_targets(spark, sharpness):
    """Soft posteriors that overlap: many rates are clipped at 0, and the totals are met all the same."""
    rng = np.random.default_rng(7)
    domain = rng.choice(3, 3000, p=[0.6, 0.3, 0.1])
    z = rng.normal(size=(3000, 3)) * 1.5 + sharpness * 2 * np.eye(3)[domain]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    n = rng.integers(1, 400, 3000)
    soft = spark.createDataFrame([(int(i), int(t), x.tolist()) for i, (t, x) in enumerate(zip(n, p))], "doc_id long, _tokens long, _domains array<double>").cache()
    found = soft.select("doc_id", mixing.rate_of(mixing.fit_rates(soft, mixing.TARGETS), mixing.F.col("_domains")).alias("rate")).collect()
    rate = np.array([r.rate for r in sorted(found)])
    goal = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS]) * (p[:, 0] @ n) / mixing.TARGETS["plain"]
    assert rate.min() == 0 and (p.T @ (n * rate)) == pytest.approx(goal, rel=1e-3)
    live = rate > 0
    prices, *_ = np.linalg.lstsq(p[live], 1 - rate[live], rcond=None)  # nearest to 1: least squares over the rates not clipped
    assert rate == pytest.approx(np.maximum(0, 1 - p @ prices), abs=1e-6)
    plain = p[:, 0] > 0.99
    assert plain.any() and rate[plain].min() > 0


def test_targets_out_of_reach_end(spark):
    """All documents alike: no rates meet the targets; the fit ends with the nearest totals."""
    soft = spark.createDataFrame([(i, 10, [1 / 3, 1 / 3, 1 / 3]) for i in range(20)], "doc_id long, _tokens long, _domains array<double>")
    rates = {r.rate for r in soft.select(mixing.rate_of(mixing.fit_rates(soft, mixing.TARGETS), mixing.F.col("_domains")).alias("rate")).collect()}
    assert list(rates) == pytest.approx([sum(mixing.TARGETS.values()) / mixing.TARGETS["plain"] / 3], rel=1e-5)
