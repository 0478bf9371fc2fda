from __future__ import annotations

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from countcast.functions import hash_bucket
from countcast.operators import features, metrics, split
from countcast.operators.grid import scenario_grid
from countcast.operators.options import option_catalogue, scenario_lists
from countcast.plans import score, train, whatif
from countcast.queries.models import WEIGHTED
from countcast.sources import registry
from countcast.sources.star import cells, headcount
from countcast.spec import CELLS, HEADCOUNT
from tests.conftest import MEDIUM, SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def lists(spark):
    return scenario_lists(option_catalogue(cells(spark, MEDIUM), CELLS), CELLS, {})


def predictor(tuned):
    return score.Predictor(CELLS, tuned.models, tuned.best)


def test_grids_have_the_expected_sizes(spark):
    assert [len(c.grid) for c in train.candidates("reference")] == [9, 2, 4]
    assert [len(c.grid) for c in train.candidates("small")] == [2, 2, 2]


def test_reference_settings(spark):
    linear, forest, boosted = (c.estimator for c in train.candidates())
    assert linear.getMaxIter() == 100
    assert (forest.getFeatureSubsetStrategy(), forest.getMaxBins(), forest.getSeed()) == ("sqrt", 150, 42)
    assert (boosted.getSubsamplingRate(), boosted.getMaxBins(), boosted.getSeed()) == (0.8, 150, 42)


def test_bins_grow_with_the_largest_dimension(spark):
    _, forest, _ = (c.estimator for c in train.candidates())
    assert train.with_bins(forest, 151).getMaxBins() == 151
    assert train.with_bins(forest, 100).getMaxBins() == 150
    assert forest.getMaxBins() == 150


def test_models_learn_the_weighted_count(spark, tuned):
    figures = {r.model: r for r in tuned.metrics.collect()}
    assert figures[train.LINEAR].r2 > 0.85 and figures[train.BOOSTED].r2 > 0.85
    spread = tuned.test.agg(F.stddev_pop("original_label")).first()[0]
    assert all(r.rmse < spread for r in figures.values())
    assert tuned.best == max(figures.values(), key=lambda r: r.r2).model
    assert [r.model for r in figures.values() if r.is_best] == [tuned.best]


def test_one_pass_metrics_agree_with_the_evaluator(tuned):
    scored, columns = score.apply_models(tuned.test, tuned.spec, tuned.models)
    ours = {r.model: r for r in metrics.regression_metrics(scored, columns).collect()}
    for name, column in columns.items():
        for metric in ("rmse", "r2", "mae"):
            evaluator = RegressionEvaluator(labelCol="original_label", predictionCol=column, metricName=metric)
            assert ours[name][metric] == pytest.approx(evaluator.evaluate(scored), rel=1e-9)


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "original_label double, p double")
    assert rows(metrics.regression_metrics(df, {"m": "p"})) == [("m", 1.0, None, 1.0)]


def test_tuning_reports_every_setting(tuned):
    tried = rows(tuned.tuning)
    assert len(tried) == 6 and all(error > 0 for _, _, error in tried)


def test_importances_sum_to_one(spark, tuned):
    for name in (train.FOREST, train.BOOSTED):
        table = train.feature_importance(spark, tuned.models[name], tuned.spec).collect()
        assert [r.feature for r in table] != [] and len(table) == len(CELLS.dims) + 1
        assert sum(r.importance for r in table) == pytest.approx(1.0)
        weights = [r.importance for r in table]
        assert weights == sorted(weights)


def test_predictions_are_at_least_one(tuned):
    assert tuned.predictions().agg(F.min("final_prediction")).first()[0] >= 1.0


def test_saved_models_predict_the_same(spark, tuned, tmp_path):
    registry.save_run(tuned.models, tuned.metrics, str(tmp_path))
    loaded, best = registry.load_models(registry.read_registry(spark, str(tmp_path)))
    assert best == tuned.best
    again, columns = score.apply_models(tuned.test, tuned.spec, loaded)
    first, _ = score.apply_models(tuned.test, tuned.spec, tuned.models)
    assert rows(again) == rows(first) and len(columns) == 3


def test_one_request_equals_the_table(spark, tuned):
    request = {"fiscal_year": "1998/99", "term_type": "Fall term", "campus": "ASIA", "faculty_group": "PROMO", "attendance": "F"}
    other = {**request, "campus": "EUROPE"}
    service = predictor(tuned)
    for name in [None, *tuned.models]:
        single = service.predict(spark, request, name).first()
        batch = service.predict_rows(spark, [other, request], name).collect()
        assert [r.request_id for r in batch] == [0, 1]
        assert batch[1].predicted_headcount == single.predicted_headcount
        assert single.model == (name or tuned.best)


def test_unknown_labels_and_future_years_are_scored(spark, tuned):
    request = {"fiscal_year": "2029/30", "term_type": "Fall term", "campus": "ATLANTIS", "faculty_group": "PROMO", "attendance": "F"}
    for name in tuned.models:
        assert predictor(tuned).predict(spark, request, name).first().predicted_headcount >= 1.0


def test_faulty_requests_are_rejected_with_a_reason(spark, tuned):
    good = ("1998/99", "Fall term", "ASIA", "PROMO", "F")
    bad = [("20a6", *good[1:]), (None, *good[1:]), (good[0], None, *good[2:])]
    data = [(i, *r) for i, r in enumerate([good, *bad])]
    schema = ", ".join(["request_id bigint", *(f"{d} string" for d in CELLS.dims)])
    requests = spark.createDataFrame(data, schema)
    assert [r.request_id for r in predictor(tuned).predict_table(requests).collect()] == [0]
    rejected = score.rejected_requests(requests, CELLS).select("request_id", "reason")
    assert rows(rejected) == [(1, "malformed year"), (2, "missing fiscal_year"), (3, "missing term_type")]


def test_empty_batches_and_unknown_models(spark, tuned):
    service = predictor(tuned)
    assert service.predict_rows(spark, [], "No Such Model").collect() == []
    request = {d: "x" for d in CELLS.dims} | {"fiscal_year": "1998/99"}
    with pytest.raises(ValueError, match="available"):
        service.predict_rows(spark, [request], "No Such Model")


def test_stacked_predictions_equal_separate_scoring(spark, tuned, lists):
    grid = scenario_grid(spark, lists)
    stacked = score.score_models(grid, CELLS, tuned.models)
    assert stacked.count() == grid.count() * 3
    for name, model in tuned.models.items():
        alone = score.score(grid, CELLS, model).select("request_id", "final_prediction")
        part = stacked.filter(F.col("model") == name).select("request_id", "final_prediction")
        assert rows(part) == rows(alone)


def test_what_if_equals_brute_force(spark, tuned, lists):
    report = {(r.model, r.dimension, r.value): r.headcount for r in whatif.what_if(spark, lists, CELLS, tuned.models, tuned.best).collect()}
    pandas = score.score_models(scenario_grid(spark, lists), CELLS, tuned.models).toPandas()
    pandas["shown"] = pandas.final_prediction.round(2)
    for model, part in pandas.groupby("model"):
        assert report.pop((model, None, None)) == pytest.approx(part.shown.mean(), abs=0.0051)
    best = pandas[pandas.model == tuned.best]
    for dim in ("fiscal_year", "term_type", "faculty_group", "attendance"):
        for value, mean in best.groupby(dim).shown.mean().items():
            assert report.pop((tuned.best, dim, value)) == pytest.approx(mean, abs=0.0051)
    assert not report


def test_what_if_refuses_bad_lists(spark, tuned, lists):
    with pytest.raises(ValueError, match="malformed year"):
        whatif.what_if(spark, lists | {"fiscal_year": ["20a6"]}, CELLS, tuned.models, tuned.best)
    with pytest.raises(ValueError, match="missing value"):
        whatif.what_if(spark, lists | {"campus": [None]}, CELLS, tuned.models, tuned.best)


def test_comparison_without_rows_is_zero(spark):
    empty = spark.createDataFrame([], "p double")
    assert rows(whatif.compare_models(empty, {"m": "p"})) == [("m", 0.0)]


def test_means_round_half_up_to_cents(spark):
    df = spark.createDataFrame([("a", 1.25), ("a", 1.26), ("b", 2.0)], "d string, final_prediction double")
    assert rows(whatif.mean_by(df, "d")) == [("a", 1.26), ("b", 2.0)]


def test_split_is_disjoint_complete_and_independent_of_layout(spark):
    facts = headcount(spark, SMALL)
    train_part, test_part = split.split(facts, HEADCOUNT.dims)
    assert train_part.intersect(test_part).isEmpty()
    assert train_part.count() + test_part.count() == facts.count()
    spread = split.split(facts.repartition(13), HEADCOUNT.dims)[0]
    assert rows(spread) == rows(train_part)


def test_folds_and_split_are_independent_draws(spark):
    keys = ["id"]
    df = spark.range(30_000).select(
        (hash_bucket(keys, 100) < 80).alias("t"), hash_bucket(keys, 3, offset=8).alias("fold")
    )
    shares = {(r.t, r.fold): r["count"] / 30_000 for r in df.groupBy("t", "fold").count().collect()}
    for (in_train, _), share in shares.items():
        assert share == pytest.approx((0.8 if in_train else 0.2) / 3, abs=0.01)


def test_random_split_is_complete(facts):
    a, b = split.random_split(facts)
    assert a.count() + b.count() == facts.count()


@pytest.mark.parametrize("partitions", [1, 8])
def test_results_do_not_depend_on_shuffle_partitions(spark, partitions):
    from __spark_entry__ import queries

    names = ["A9_all_totals_in_one_pass", "L1_split_sizes", "M1_category_index", "L6_fold_sizes", "P6_distinct_counts"]
    expected = {n: rows(queries()[n](spark, SMALL)) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in names:
            assert rows(queries()[name](spark, SMALL)) == expected[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_training_drops_unusable_rows_and_accepts_zero_counts(facts, spec):
    odd = facts.withColumn("fiscal_year", F.when(F.col("headcount") == 22, "FY21").otherwise(F.col("fiscal_year")))
    ready = train.prepare(odd, spec, spec.dims, 3)
    assert ready.count() == 9
    assert ready.filter("headcount = 0").first().label == 0.0


def test_layout_depends_on_size_alone(spark):
    assert [train.partitions_for(n) for n in (0, 1, 10_000, 10_001, 2_000_000, 150_000_000, 300_000_000)] == [1, 1, 1, 2, 200, 200, 300]
    table = spark.range(30_000).select("id", (F.col("id") % 7).alias("v"))
    pieces = [train.laid_out(t, ["id"]).rdd.glom().collect() for t in (table, table.coalesce(1).orderBy(F.desc("v")), table.repartition(23))]
    assert len(pieces[0]) == 3 and pieces[0] == pieces[1] == pieces[2]
    ties = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 3.0)], "k int, v double")
    assert [r.v for r in train.laid_out(ties.repartition(3), ["k"]).collect()] == [1.0, 2.0, 3.0]


def test_trees_do_not_depend_on_the_layout_of_the_facts(spark, monkeypatch):
    monkeypatch.setattr(train, "ROWS_PER_TASK", 300)
    facts = cells(spark, SMALL)
    models = []
    for c in train.candidates("small")[1:]:
        settings = {"numTrees": [12], "maxDepth": [5]} if c.name == train.FOREST else {"maxIter": [5], "maxDepth": [4]}
        c.grid = train.param_grid(c.estimator, settings)
        models.append(c)
    grown = []
    for layout in (facts, facts.repartition(13), facts.coalesce(1).orderBy("campus", F.desc("fiscal_year"))):
        run = train.train(layout, WEIGHTED, models)
        grown.append([run.models[c.name].stages[-1].toDebugString.split("\n", 1)[1] for c in models])
    assert grown[0] == grown[1] == grown[2] and "Tree 11" in grown[0][0]


def test_single_valued_dimension_trains(spark):
    facts = cells(spark, SMALL).withColumn("campus", F.lit("Main"))
    keys = ["fiscal_year", "term_type", "faculty_group", "attendance"]
    totals = facts.groupBy(*keys, "campus").agg(F.sum("weighted_headcount").alias("weighted_headcount"))
    for candidate in train.candidates("small"):
        candidate.grid = candidate.grid[:1]
        run = train.train(totals, WEIGHTED, [candidate], keys=keys)
        assert run.best == candidate.name and run.tuning.isEmpty()


def test_whole_chain_tuning(spark):
    forest = next(c for c in train.candidates("small") if c.name == train.FOREST)
    run = train.train(cells(spark, SMALL), WEIGHTED, [forest], refit_features=True)
    assert run.tuning.count() == 2 and run.best == train.FOREST
    assert isinstance(features.indexer_of(run.models[train.FOREST]).labelsArray, list)


def test_unseen_and_null_labels_share_the_last_index(spark, facts, spec):
    known = features.with_year(facts.dropna(), spec)
    model = features.fit_features(known, spec, "linear")
    strange = known.limit(1).withColumns({"faculty_group": F.lit("NEW"), "campus": F.lit(None).cast("string")})
    row = model.transform(strange).first()
    assert row.faculty_group_idx == 3.0 and row.campus_idx == 1.0
    assert row.faculty_group_ohe.numNonzeros() == 0 and row.campus_ohe.numNonzeros() == 0


def test_scoring_matches_a_single_chain(tuned):
    name = tuned.best
    alone = tuned.models[name].transform(features.with_year(tuned.test, tuned.spec))
    expected = alone.select(*CELLS.dims, F.greatest(F.expm1("prediction"), F.lit(1.0)).alias("p"))
    scored, columns = score.apply_models(tuned.test, tuned.spec, tuned.models)
    assert rows(scored.select(*CELLS.dims, F.col(columns[name]).alias("p"))) == rows(expected)
