"""Newton's logistic regression against the conditions of an optimum."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators.models import fit_sigmoid
from keelson.operators.newton import fit_newton


def table(spark, n=400, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = draw.gauss(0, 3), draw.random()
        rows.append((i, a, b, a + 1, int(a - 2 * b + draw.gauss(0, 1) > 0), 1.0 + i % 3))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double")


def gradient(rows, model, penalty):
    at = np.array([*model.coefficients, model.intercept])
    total = penalty * np.append(at[:-1], 0.0)
    for r in rows:
        x = np.array([r["a"], r["b"], r["c"], 1.0])
        total += r["w"] * (1 / (1 + math.exp(-(x @ at))) - r["y"]) * x
    return total


@pytest.mark.parametrize("penalty", [1.0, 0.01])
def test_the_gradient_vanishes_on_any_partitions(spark, penalty):
    rows = table(spark)
    args = [F.col(c) for c in "abc"], F.col("y"), F.col("w"), penalty
    model = fit_newton(rows.repartition(5), *args)
    assert abs(gradient(rows.collect(), model, penalty)).max() < 1e-8
    again = fit_newton(rows.coalesce(1), *args)
    assert np.allclose(model.coefficients, again.coefficients, rtol=0, atol=1e-9)


def test_equal_columns_without_penalty_and_missing_values(spark):
    rows = table(spark).withColumn("c", F.col("a"))
    some = rows.unionByName(rows.limit(3).withColumn("a", F.lit(None).cast("double")))
    model = fit_newton(some, [F.col(c) for c in "abc"], F.col("y"), F.col("w"))
    assert abs(gradient(rows.collect(), model, 0.0)).max() < 1e-6


def test_separable_and_empty_targets_end(spark):
    rows = table(spark).withColumn("y", (F.col("a") > 0).cast("int"))
    model = fit_newton(rows, [F.col("a")], F.col("y"), F.col("w"))
    assert model.coefficients[0] > 1 and math.isfinite(model.intercept)
    assert fit_newton(rows.limit(0), [F.col("a")], F.col("y"), F.col("w")) == ([0.0], 0.0)


def test_sigmoid_calibration_meets_its_targets(spark):
    rows = table(spark)
    slope, intercept = fit_sigmoid(rows, "a", "y")
    values = rows.collect()
    ones = sum(r["y"] for r in values)
    high, low = (ones + 1) / (ones + 2), 1 / (len(values) - ones + 2)
    misses = [1 / (1 + math.exp(-(slope * r["a"] + intercept))) - (high if r["y"] else low) for r in values]
    assert abs(sum(misses)) < 1e-8
    assert abs(sum(m * r["a"] for m, r in zip(misses, values, strict=True))) < 1e-7
