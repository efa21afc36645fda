"""The drift posterior in columns against the fitted models' own."""

import numpy as np
import pytest

from barloom.models.returns import drift_posterior
from barloom.operators import posterior

KW = {"horizon": 5, "prior_mean": 0.002, "prior_sd": 0.004, "effect_sd": 0.003}
COLUMNS = "ticker string, position int, forward double, " + ", ".join(f"{c} double" for c in posterior.EVIDENCE)


def series(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7))
    forward = 0.01 * x[:, 0] - 0.004 * x[:, 4] + 0.02 * rng.normal(size=n)
    x[:30, 4], x[:, 3], x[rng.integers(0, n, 20), 1] = np.nan, 0.5, np.nan  # a burn-in, one that never varies, gaps
    x[-1, 2], forward[-5:] = np.nan, np.nan
    return x, forward


@pytest.mark.parametrize("n", [60, 400, 703])
def test_posteriors_equal_the_model(spark, n):
    tickers = {"A": series(n, 1), "B": series(n - 3, 2)}
    held = lambda v: None if np.isnan(v) else float(v)
    rows = [(t, k, held(f[k]), *map(held, x[k])) for t, (x, f) in tickers.items() for k in range(len(f))]
    got = {r["ticker"]: r for r in posterior.drift_posteriors(spark.createDataFrame(rows, COLUMNS), **KW).collect()}
    for t, (x, f) in tickers.items():
        want = drift_posterior(x, posterior.EVIDENCE, f, len(f) - 1, **KW)
        assert got[t]["outcomes"] == want.rows
        assert got[t]["mean"] == pytest.approx(want.mean, rel=1e-9) and got[t]["sd"] == pytest.approx(want.sd, rel=1e-9)
        assert got[t]["baseline"] == pytest.approx(want.contributions["baseline"], rel=1e-9)
        for c in posterior.EVIDENCE:
            assert (got[t][c] is None) == (c not in want.contributions)
            assert got[t][c] is None or got[t][c] == pytest.approx(want.contributions[c], rel=1e-8, abs=1e-14)
