"""Ordinary least squares from sums of products.

Two aggregations over a narrow table give all that the fit needs: the means and
ranges, then the products of the centred columns. What reaches the driver is one
row of (features + 1) squared numbers, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPENDENT = 1e-10   # share of a feature's variance that the features taken before must leave


def minimum_norm(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """The shortest of all vectors that solve the normal equations.

    A Cholesky factorisation that takes the feature with the largest share of its
    variance left (ties: the first) finds independent features; a feature that
    these explain but for ``DEPENDENT`` of its variance depends on them. The
    solution over the independent ones is then spread to its dependents with the
    least sum of squares. A feature without variance gets 0.
    """
    out = np.zeros(len(gram))
    live = np.flatnonzero(gram.diagonal() > 0)
    if not len(live):
        return out
    size = np.sqrt(gram.diagonal()[live])
    corr = gram[np.ix_(live, live)] / np.outer(size, size)
    left, factor, taken = np.ones(len(live)), np.zeros_like(corr), []
    while len(taken) < len(live):
        k = int(np.argmax(left))
        if left[k] <= DEPENDENT:
            break
        step = len(taken)
        factor[:, step] = (corr[:, k] - factor[:, :step] @ factor[k, :step]) / np.sqrt(left[k])
        left = left - factor[:, step] ** 2
        taken.append(k)
        left[taken] = 0
    rest = [i for i in range(len(live)) if i not in taken]
    base = corr[np.ix_(taken, taken)]
    own = np.linalg.solve(base, (moments[live] / size)[taken]) / size[taken]
    by = np.linalg.solve(base, corr[np.ix_(taken, rest)]) * size[rest] / size[taken][:, None]
    spread = np.hstack([np.eye(len(taken)), by])
    out[live[taken + rest]] = spread.T @ np.linalg.solve(spread @ spread.T, own)
    return out


def least_squares(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """``feature, coefficient`` for each feature and for ``intercept``.

    Rows with a null or NaN in a used column take no part; without any complete
    row the result is empty. A constant feature gets 0, features that depend on
    each other the solution of least norm. ``rows`` is read twice, so give a
    written or cheap table.
    """
    spark = rows.sparkSession
    used = [*features, label]
    full = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(used)])
    for i in range(len(used)):
        full = full.where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
    first = full.agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(used))
                                               for k, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]).first()
    schema = "feature string, coefficient double"
    if not first["n"]:
        return spark.createDataFrame([], schema)
    mean = [first[f"mean{i}"] for i in range(len(used))]
    off = [F.col(f"x{i}") - F.lit(m) for i, m in enumerate(mean)]
    pairs = [(i, j) for i in range(len(used)) for j in range(i, len(used))]
    sums = full.agg(*[F.sum(off[i] * off[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    product = np.zeros((len(used), len(used)))
    for i, j in pairs:
        if all(first[f"low{k}"] < first[f"high{k}"] for k in (i, j)):
            product[i, j] = product[j, i] = sums[f"s{i}_{j}"]
    w = minimum_norm(product[:-1, :-1], product[:-1, -1])
    shift = mean[-1] - float(w @ np.array(mean[:-1]))
    return spark.createDataFrame([*zip(features, map(float, w)), ("intercept", shift)], schema)


def residual(fit: DataFrame, features: list[str], label: str):
    """Column: the label less its fitted value (``fit`` has one row per feature)."""
    w = {r["feature"]: r["coefficient"] for r in fit.collect()}
    guess = F.lit(w.get("intercept"))
    for f in features:
        guess = guess + F.lit(w.get(f)) * F.col(f)
    return F.col(label) - guess
