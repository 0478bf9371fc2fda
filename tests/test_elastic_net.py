"""Linear settings tuned from sums of products, against fits on the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression

from countcast import CountSpec
from countcast.operators import features
from countcast.plans import elastic_net, train
from countcast.queries.models import WEIGHTED
from countcast.queries.tuning import _training_rows
from tests.conftest import SMALL


def sums_of(x, y):
    return elastic_net.Sums(float(len(y)), x.sum(0), x.T @ x, x.T @ y, float(y.sum()), float(y @ y))


def problem(seed):
    """One-hot blocks whose columns add up to others, a year among them, and a constant column."""
    rng = np.random.default_rng(seed)
    n, labels = int(rng.integers(20, 150)), int(rng.integers(2, 6))
    g, h = rng.integers(0, labels, n), rng.integers(0, 3, n)
    x = np.column_stack((np.eye(labels)[g], np.eye(3)[h], 2000.0 + g, np.zeros(n)))
    return x, rng.normal(size=n) + g * rng.normal() + h


@pytest.mark.parametrize("mix", [0.3, 0.5, 1.0])
@pytest.mark.parametrize("intercept", [True, False])
def test_descent_ends_at_the_optimum(mix, intercept):
    for seed in range(40):
        p = elastic_net._Scaled.of(sums_of(*problem(seed)), intercept)
        for reg in (0.001, 0.01, 0.1, 3.0):
            beta = elastic_net._descend([p], [elastic_net.Setting(reg, mix, intercept)])[0]
            l1, l2 = reg * mix / p.label_scale, reg * (1 - mix) / p.label_scale
            pull = p.target - p.matrix @ beta - l2 * beta
            zero = beta == 0
            assert np.abs(pull[~zero] - l1 * np.sign(beta[~zero])).max(initial=0) < 1e-6
            assert (np.abs(pull[zero & (p.scale > 0)]).max(initial=0) - l1) < 1e-6 and not beta[-1]


def test_ridge_equals_the_normal_equations():
    x, y = problem(3)
    (coefficients, intercept), = elastic_net.solve([(sums_of(x, y), elastic_net.Setting(0.05, 0.0))])
    use = x.std(0) > 0
    z = (x[:, use] - x[:, use].mean(0)) / x[:, use].std(0)
    t = (y - y.mean()) / y.std()
    beta = np.linalg.solve(z.T @ z / len(y) + 0.05 / y.std() * np.eye(z.shape[1]), z.T @ t / len(y))
    assert np.allclose(coefficients[use], beta * y.std() / x[:, use].std(0)) and not coefficients[~use].any()
    assert intercept == pytest.approx(y.mean() - coefficients @ x.mean(0))
    error = elastic_net.Sums.mean_squared_error(sums_of(x, y), coefficients, intercept)
    assert error == pytest.approx(np.mean((y - x @ coefficients - intercept) ** 2))


def test_all_nine_settings_equal_fits_on_each_fold(spark):
    rows = _training_rows(spark, SMALL)
    indexer = features.fit_indexer(rows, WEIGHTED)
    linear = train.candidates("reference")[0]
    ready = features.fit_features(rows, WEIGHTED, "linear", indexer).transform(rows).cache()
    ours = elastic_net.tune_errors(indexer.transform(rows), indexer, WEIGHTED, linear.estimator, linear.grid)
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse")
    for settings, error in zip(linear.grid, ours):
        fits = [linear.estimator.fit(ready.where(f"fold <> {k}"), settings).transform(ready.where(f"fold = {k}")) for k in range(3)]
        ridge = not settings[linear.estimator.elasticNetParam]
        # the quasi-Newton solver that fits L1 settings row by row stops a little before the optimum
        assert np.mean([evaluator.evaluate(f) for f in fits]) == pytest.approx(error, abs=1e-9 if ridge else 2e-5)
    ready.unpersist()


def test_unseen_labels_and_scopes_without_dimensions_or_year(spark):
    rows = spark.createDataFrame(
        [(k % 3, float(k % 4), "ab"[k % 2], ["x", "y", "z"][k % 3], 2000.0 + k % 5) for k in range(60)],
        "fold int, label double, d string, e string, numeric_year double",
    )
    known = rows.where("e <> 'z'")
    evaluator = RegressionEvaluator(labelCol="label", metricName="rmse")
    for dims, year in ((("d", "e"), "y"), (("d",), None), ((), "y")):
        spec = CountSpec(dims, "n", year)
        indexer = features.fit_indexer(known, spec)  # z is unseen: all zeros in its block
        estimator = LinearRegression(labelCol="label", regParam=0.02)
        grid = train.param_grid(estimator, {"fitIntercept": [True, False]})
        chain = features.fit_features(known, spec, "linear", indexer)
        ready = chain.transform(rows)
        indexed = indexer.transform(rows) if indexer else rows
        for settings, error in zip(grid, elastic_net.tune_errors(indexed, indexer, spec, estimator, grid)):
            fits = [estimator.fit(ready.where(f"fold <> {k}"), settings).transform(ready.where(f"fold = {k}")) for k in range(3)]
            assert np.mean([evaluator.evaluate(f) for f in fits]) == pytest.approx(error, rel=1e-6)


def test_one_value_and_empty_folds(spark):
    rows = spark.createDataFrame([(0, 2.0, "a", 2000.0), (1, 2.0, "a", 2000.0)], "fold int, label double, d string, numeric_year double")
    spec = CountSpec(("d",), "n", "y")
    indexer = features.fit_indexer(rows, spec)
    estimator = LinearRegression(labelCol="label")
    grid = train.param_grid(estimator, {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]})
    assert elastic_net.tune_errors(indexer.transform(rows), indexer, spec, estimator, grid) == [0.0] * 4
    alone = indexer.transform(rows.where("fold = 0"))
    errors = elastic_net.tune_errors(alone, indexer, spec, estimator, grid)
    assert np.isnan(errors).all() and train.best_setting([float("nan"), 2.0, 1.0, 1.0]) == 2


def test_only_what_sums_can_tell_is_tuned_from_sums():
    line = LinearRegression()
    grid = train.param_grid(line, {"regParam": [0.1, 0.2]})
    assert elastic_net.tunable(line, grid, 100) and not elastic_net.tunable(line, grid, elastic_net.WIDEST + 1)
    assert not elastic_net.tunable(LinearRegression(loss="huber"), grid, 10)
    assert not elastic_net.tunable(LinearRegression(weightCol="w"), grid, 10)
    assert not elastic_net.tunable(line, train.param_grid(line, {"maxIter": [1, 2]}), 10)
    assert not elastic_net.tunable(train.candidates()[1].estimator, grid, 10)


def test_sums_are_one_scan_and_one_shuffle(spark):
    rows = _training_rows(spark, SMALL)
    indexer = features.fit_indexer(rows, WEIGHTED)
    table = spark.createDataFrame(rows.rdd, rows.schema)
    plan = elastic_net.fold_sums(indexer.transform(table), indexer, WEIGHTED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1 and "Python" not in plan
