"""Logistic regression by Newton steps over aggregated Gram matrices.

Each step is one pass: tasks add up the gradient and the weighted Gram matrix of their rows, one
aggregate merges these few numbers, and the driver solves a system of the size of the features. A
handful of passes reach the optimum to rounding, so the result does not depend on a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import cut_lineage

#: Steps at most; a convex loss with halved steps needs far fewer.
MOST_STEPS = 100
#: The largest change of a coefficient in a last step, relative to the largest coefficient.
ENOUGH = 1e-10
#: Relative rounding error allowed for in sums of losses.
ROUNDING = 1e-12


class LinearModel(NamedTuple):
    coefficients: list[float]
    intercept: float

    def margin(self, features: Sequence[Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, value in zip(self.coefficients, features, strict=True):
            total = total + value * weight
        return total


def _sums(at: np.ndarray):
    """Loss, gradient and upper Gram matrix at the coefficients ``at``, by task."""
    upper = np.triu_indices(len(at))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(at) + len(upper[0]))
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = np.column_stack((x, np.ones(len(x))))
            target, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            margin = x @ at
            chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            total[0] += (weight * (np.logaddexp(0, margin) - target * margin)).sum()
            total[1 : 1 + len(at)] += x.T @ (weight * (chance - target))
            total[1 + len(at) :] += (x.T @ (x * (weight * chance * (1 - chance))[:, None]))[upper]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"]
        )

    return add


def fit_newton(
    rows: DataFrame, features: Sequence[Column], target: Column, weight: Column, penalty: float = 0.0
) -> LinearModel:
    """Minimise ``sum(weight * loss) + penalty / 2 * |coefficients|^2``; the intercept is free.

    ``target`` may be any number in [0, 1]. Without a penalty a separable target has no optimum: the
    steps then end when they no longer lower the loss. Rows with a null are left out; a table
    without rows gives zeros.
    """
    width = len(features) + 1
    table = cut_lineage(
        rows.select(
            F.array(*features).alias("x"), target.cast("double").alias("y"), weight.cast("double").alias("w")
        ).where("y is not null and w is not null and not exists(x, v -> v is null)")
    )
    upper = np.triu_indices(width)
    ridge = np.append(np.full(width - 1, float(penalty)), 0.0)

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = (
            table.mapInArrow(_sums(at), "place long, value double")
            .groupBy("place")
            .agg(F.sum("value").alias("value"))
            .toArrow()
            .sort_by("place")["value"]
            .to_numpy()
        )
        if not len(found):
            found = np.zeros(1 + width + len(upper[0]))
        gram = np.zeros((width, width))
        gram[upper] = found[1 + width :]
        gram = gram + np.triu(gram, 1).T
        return found[0] + (ridge * at * at).sum() / 2, found[1 : 1 + width] + ridge * at, gram + np.diag(ridge)

    at = np.zeros(width)
    loss, gradient, gram = evaluate(at)
    for _ in range(MOST_STEPS):
        step = np.linalg.lstsq(gram, -gradient, rcond=1e-14)[0]
        size = 1.0
        while True:
            new = at + size * step
            new_loss, new_gradient, new_gram = evaluate(new)
            # Near the optimum losses differ by less than their rounding.
            lower = new_loss <= loss + ROUNDING * abs(loss)
            if lower or size < 1e-6:
                break
            size /= 2
        if not lower:
            break
        change = np.abs(new - at).max()
        at, loss, gradient, gram = new, new_loss, new_gradient, new_gram
        if change <= ENOUGH * max(1.0, np.abs(at).max()):
            break
    return LinearModel(at[:-1].tolist(), float(at[-1]))
