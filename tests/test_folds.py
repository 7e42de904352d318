"""All folds' calibrations at once against a fit of each by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate

FEATURES = ["a", "b", "c"]


def made(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.2]
    y = (x @ [0.8, -0.4, 1.0] + rng.normal(size=n) > 0.5).astype(int)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)], "doc_id long, a double, b double, c double, label int")


def test_coefficients_equal_separate_fits(spark):
    rows = made(spark).cache()
    models = evaluate.fold_models(rows, FEATURES)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    assert sorted(models) == list(range(5))
    want = {}
    for k in range(5):
        own = evaluate.fit_calibration(rows.where(fold != k), FEATURES)
        have = models[k]
        assert have["n_samples"] == own["n_samples"]
        for got, other in [*((have["coefficients"][f], own["coefficients"][f]) for f in FEATURES), (have["intercept"], own["intercept"])]:
            assert got == pytest.approx(other, abs=1e-6)
        held = rows.where(fold == k).collect()
        right = [(sum(own["coefficients"][f] * r[f] for f in FEATURES) + own["intercept"] > 0) == (r.label == 1) for r in held]
        want[k] = (len(held), pytest.approx(sum(right) / len(right)))
    got = {r.fold: (r.n, r.accuracy) for r in evaluate.cross_validated(rows, FEATURES).collect()}
    assert got == want


def test_separable_and_constant_features_end(spark):
    rows = made(spark, 120).withColumn("label", (F.col("a") > 0).cast("int")).withColumn("b", F.lit(0.0))
    models = evaluate.fold_models(rows, FEATURES)
    assert len(models) == 5 and all(m["coefficients"]["a"] > 0 and abs(m["coefficients"]["b"]) < 1e-9 for m in models.values())


def test_one_class_or_few_rows_have_no_models(spark):
    assert evaluate.fold_models(made(spark, 40).withColumn("label", F.lit(1)), FEATURES) == {}
    assert evaluate.cross_validated(made(spark, 6), FEATURES).count() == 0
