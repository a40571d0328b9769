"""Least squares from sums of products against numpy."""
import numpy as np
import pytest

from pagesieve.operators import regression as RG

NAMES = list("abcdef")


def _table(spark, x, y, extra=()):
    schema = ", ".join(f"{c} double" for c in [*NAMES[:x.shape[1]], "y"])
    return spark.createDataFrame([[*map(float, a), float(b)] for a, b in zip(x, y, strict=True)] + list(extra), schema)


def _numpy(x, y):
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    return [*w, y.mean() - w @ x.mean(0)]


@pytest.mark.parametrize("kind", ["plain", "constant", "equal", "dependent"])
def test_equals_numpy(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [1, 3, 0.1, 20, 1]
    if kind == "constant":
        x[:, 2] = 0.1
    if kind == "equal":
        x[:, 4] = x[:, 0]
    if kind == "dependent":
        x[:, 1] = 2 * x[:, 0] - x[:, 3] + 7
    y = x @ [1, -2, 3, 0.5, 0] + 4 + rng.normal(size=300)
    null = [(None, 1.0, 1.0, 1.0, 1.0, 9e9), (1.0, 1.0, float("nan"), 1.0, 1.0, 9e9)]
    fit = {r["feature"]: r["coefficient"] for r in RG.least_squares(_table(spark, x, y, null), NAMES[:5], "y").collect()}
    assert [fit[c] for c in [*NAMES[:5], "intercept"]] == pytest.approx(_numpy(x, y), abs=1e-6)


def test_large_offset_keeps_its_digits(spark):
    x = np.arange(50.0)[:, None] + 1e9
    fit = RG.least_squares(_table(spark, x, 2 * (x[:, 0] - 1e9) + 1), ["a"], "y").collect()
    assert fit[0]["coefficient"] == pytest.approx(2)


def test_no_rows_and_one_row(spark):
    one = _table(spark, np.array([[3.0]]), np.array([5.0]))
    assert RG.least_squares(one.limit(0), ["a"], "y").count() == 0
    assert [r["coefficient"] for r in RG.least_squares(one, ["a"], "y").collect()] == [0.0, 5.0]
