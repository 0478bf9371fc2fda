"""Features, splits, training, comparison, saved models.

Three *closed-form* models let SQL check training, saving and scoring exactly: a one-feature
least-squares line, and two trees deep enough to give every value combination its own
leaf, so that their predictions are group means. The tuned models are checked by their
invariants in the tests.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from countcast import functions
from countcast.operators import features, metrics
from countcast.operators.category_index import category_index as category_index_table
from countcast.operators.category_index import label_counts, with_category_index, with_vectors
from countcast.operators.split import fold_sizes, in_training
from countcast.plans import train
from countcast.plans.importance import permutation_importance
from countcast.plans.score import apply_models, stack_predictions
from countcast.queries.catalogue import query, round6, unpivot_sql
from countcast.sources import documents, registry
from countcast.sources.star import cells, headcount, order_lines
from countcast.spec import CELLS, HEADCOUNT, CountSpec
from countcast.workspace import scratch_path

_DIMS = ", ".join(HEADCOUNT.dims)
_CELL_DIMS = ", ".join(CELLS.dims)

# The count the models of this module learn.
WEIGHTED = CountSpec(CELLS.dims, "weighted_headcount", CELLS.year_dim)
FOREST_DIMS = ("term_type", "attendance")
BOOSTED_DIMS = ("campus", "faculty_group")


def closed_form_models() -> list[train.Candidate]:
    columns = {"featuresCol": "features", "labelCol": "label"}
    exact_line = LinearRegression(regParam=0.0, solver="normal", **columns)
    one_tree = RandomForestRegressor(
        numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=10, maxBins=150, seed=42, **columns
    )
    one_boost = GBTRegressor(maxIter=1, maxDepth=12, maxBins=150, seed=42, **columns)
    target = WEIGHTED.target
    return [
        train.Candidate(train.LINEAR, "linear", exact_line, scope=CountSpec((), target, "fiscal_year")),
        train.Candidate(train.FOREST, "tree", one_tree, scope=CountSpec(FOREST_DIMS, target, None)),
        train.Candidate(train.BOOSTED, "tree", one_boost, scope=CountSpec(BOOSTED_DIMS, target, None)),
    ]


_runs: dict[tuple[str, str, str], train.TrainingRun] = {}


def _trained(spark, path, kind: str, counted=None) -> train.TrainingRun:
    """One training run per session and data folder, shared by the queries that score.

    ``counted``: stored facts, if the query has them, to train from instead of the lines.
    """
    key = (spark.sparkContext.applicationId, path, kind)
    if key not in _runs:
        models = closed_form_models() if kind == "closed form" else train.candidates(kind)
        _runs[key] = train.train(cells(spark, path, counted), WEIGHTED, models, parallelism=4)
    return _runs[key]


def closed_form_run(spark, path, counted=None) -> train.TrainingRun:
    return _trained(spark, path, "closed form", counted)


def tuned_run(spark, path, counted=None) -> train.TrainingRun:
    return _trained(spark, path, "small", counted)


def bucket_sql(keys: str, buckets: int, start: int = 1) -> str:
    return f"cast(concat('0x', substr(md5(concat_ws('|', {keys})), {start}, 8)) as bigint) % {buckets}"


# The closed-form models in SQL: `pairs` holds each test row with each model's prediction.
TRAINED = f"""
labelled as (
  select *, ln(1 + weighted_headcount) as label, cast(weighted_headcount as double) as original_label,
         cast(substr(fiscal_year, 1, 4) as double) as numeric_year,
         {bucket_sql(_CELL_DIMS, 100)} < 80 as in_train
  from cells
),
line as (select regr_slope(label, numeric_year) as slope, regr_intercept(label, numeric_year) as intercept
         from labelled where in_train),
forest as (select term_type, attendance, avg(label) as p from labelled where in_train group by 1, 2),
boosted as (select campus, faculty_group, avg(label) as p from labelled where in_train group by 1, 2)"""


def predictions_sql(source: str, keys: str) -> str:
    """Predictions of the three models for ``source``, which has the cell dimensions."""
    year = "cast(substr(fiscal_year, 1, 4) as double)"
    return f"""
  select {keys}, '{train.LINEAR}' as model,
         greatest(exp(slope * {year} + intercept) - 1, 1.0) as final_prediction from {source}, line
  union all
  select {keys}, '{train.FOREST}', greatest(exp(p) - 1, 1.0) from {source} join forest using (term_type, attendance)
  union all
  select {keys}, '{train.BOOSTED}', greatest(exp(p) - 1, 1.0) from {source} join boosted using (campus, faculty_group)"""


_TEST = f"""{TRAINED},
test as (select * from labelled where not in_train),
pairs as ({predictions_sql("test", f"{_CELL_DIMS}, original_label")}),
measured as (
  select model, sqrt(avg((original_label - final_prediction) ** 2)) as rmse,
         1 - avg((original_label - final_prediction) ** 2) / var_pop(original_label) as r2,
         avg(abs(original_label - final_prediction)) as mae
  from pairs group by model
)"""
_METRICS = "select model, round(rmse, 6) as rmse, round(r2, 6) as r2, round(mae, 6) as mae from measured"
_REGISTRY = """select model, replace(replace(lower(model), ' ', '_'), '-', '_') as folder, round(rmse, 6) as rmse,
  round(r2, 6) as r2, round(mae, 6) as mae, r2 = max(r2) over () as is_best from measured"""


# Labels and features ------------------------------------------------------------------


@query(
    "X1_numeric_year",
    "select o_orderkey, try_cast(substr(name, 1, 4) as double) as numeric_year from (select o_orderkey, "
    "case when o_orderstatus = 'P' then 'FY' else '' end || cast(year(o_orderdate) as varchar) || '/xx' as name from orders)",
)
def numeric_year(spark, path):
    """Well-formed years, and malformed ones that become null."""
    prefix = F.when(F.col("o_orderstatus") == "P", "FY").otherwise("")
    orders = spark.read.parquet(f"{path}/orders.parquet")
    named = orders.select("o_orderkey", F.concat(prefix, F.year("o_orderdate").cast("string"), F.lit("/xx")).alias("name"))
    return features.with_year(named, CountSpec(("name",), "n", "name")).drop("name")


_LABELS = f"""select {_DIMS}, round(ln(1 + headcount), 6) as label, cast(headcount as double) as original_label,
  cast(substr(fiscal_year, 1, 4) as double) as numeric_year from headcount"""


@query("M6_labels", _LABELS)
def labels(spark, path):
    labelled = features.with_labels(headcount(spark, path), HEADCOUNT)
    return labelled.select(*HEADCOUNT.dims, *round6("label"), "original_label", "numeric_year")


@query(
    "X3_log_label",
    "select l_orderkey, l_linenumber, l_extendedprice, round(ln(1 + l_quantity), 6) as label from lineitem",
)
def log_label(spark, path):
    lines = spark.read.parquet(f"{path}/lineitem.parquet")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.round(functions.log_label(F.col("l_quantity")), 6).alias("label"),
    )


@query(
    "X7_count_as_double",
    "select cast(headcount as double) as original_label, 1.0::double as one, count(*) as rows from headcount group by 1",
)
def count_as_double(spark, path):
    counts = features.with_labels(headcount(spark, path), HEADCOUNT)
    return counts.groupBy("original_label", F.lit(1.0).alias("one")).agg(F.count("*").alias("rows"))


@query("F3_feature_columns", f"select * from (values {', '.join(f'({i}, {d!r})' for i, d in enumerate(HEADCOUNT.dims))}) as f(position, feature) where exists (select 1 from headcount)")
def feature_columns(spark, path):
    """All columns but the target, with the fact table deciding which columns there are."""
    facts = headcount(spark, path)
    dims = CountSpec.of(facts, "headcount").dims
    present = facts.agg(*(F.count_if(F.col(d).isNotNull()).alias(d) for d in dims))
    held = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(d).alias("feature"), F.col(d).alias("n")) for i, d in enumerate(dims)))
    return present.select(F.inline(held)).filter("n > 0").drop("n")


_INDEX = f"""indexed as (
  select dimension, value, cast(row_number() over (partition by dimension order by n desc, value) - 1 as double) as index
  from (select dimension, value, count(*) as n from ({{rows}}) group by 1, 2)
)"""
_CELL_INDEX = _INDEX.format(rows=unpivot_sql("cells", CELLS.dims))


@query(
    "M1_category_index",
    "select dimension, value, index from indexed",
    ctes=_INDEX.format(rows=unpivot_sql("headcount", HEADCOUNT.dims)),
)
def category_index(spark, path):
    facts = headcount(spark, path)
    return features.label_table(facts, features.fit_features(facts, HEADCOUNT, "tree"))


@query(
    "M1_category_index_joined",
    "select dimension, value, index from indexed",
    ctes=_INDEX.format(rows=unpivot_sql("headcount", HEADCOUNT.dims)),
)
def category_index_joined(spark, path):
    """The same numbers from a distributed rank: no label on the driver."""
    return category_index_table(headcount(spark, path), HEADCOUNT)


@query(
    "M1_index_of_every_order_key",
    """select l_orderkey, cast(dense_rank() over (order by n desc, cast(l_orderkey as varchar)) - 1 as double) as orderkey_idx, count(*) as lines
from (select l_orderkey, count(*) over (partition by l_orderkey) as n from lineitem) group by l_orderkey, n""",
)
def index_of_every_order(spark, path):
    """A dimension with as many labels as there are orders, joined to its lines."""
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("orderkey"), "l_orderkey")
    spec = CountSpec(("orderkey",), "n", None)
    indexed = with_category_index(lines, spec, category_index_table(lines, spec))
    return indexed.groupBy("l_orderkey", "orderkey_idx").agg(F.count("*").alias("lines"))


def _offset(i: int) -> str:
    before = ", ".join(f"'{d}'" for d in CELLS.dims[:i])
    return f"(select count(*) from indexed where dimension in ({before}))" if i else "0"


_ONE_HOT = " union all ".join(
    f"select {_CELL_DIMS}, cast({_offset(i)} + index as integer) as slot, cast(1 as double) as weight "
    f"from cells join indexed on dimension = '{d}' and value = {d}"
    for i, d in enumerate(CELLS.dims)
)
_YEAR_SLOT = (
    f"select {_CELL_DIMS}, cast({{slot}} as integer) as slot, "
    "cast(substr(fiscal_year, 1, 4) as double) as weight from cells"
)


def _vectors(spark, path, kind):
    facts = features.with_year(cells(spark, path), CELLS)
    return features.fit_features(facts, CELLS, kind).transform(facts)


_M3 = f"{_ONE_HOT} union all {_YEAR_SLOT.format(slot='(select count(*) from indexed)')}"


@query("M2_one_hot_slots", f"select * from ({_M3}) where weight = 1", ctes=_CELL_INDEX)
def one_hot_slots(spark, path):
    return features.vector_slots(_vectors(spark, path, "linear"), list(CELLS.dims)).filter("weight = 1")


@query("M3_linear_vector", _M3, ctes=_CELL_INDEX)
def linear_vector(spark, path):
    return features.vector_slots(_vectors(spark, path, "linear"), list(CELLS.dims), nonzero_only=True)


_M4 = (
    " union all ".join(
        f"select {_CELL_DIMS}, {i} as slot, index as weight from cells join indexed on dimension = '{d}' and value = {d}"
        for i, d in enumerate(CELLS.dims)
    )
    + f" union all {_YEAR_SLOT.format(slot=len(CELLS.dims))}"
)


@query("M4_tree_vector", _M4, ctes=_CELL_INDEX)
def tree_vector(spark, path):
    return features.vector_slots(_vectors(spark, path, "tree"), list(CELLS.dims))


def _joined_vectors(spark, path, kind):
    facts = features.with_year(cells(spark, path), CELLS)
    index = category_index_table(facts, CELLS)
    counts = label_counts(index, CELLS)
    return with_vectors(with_category_index(facts, CELLS, index, counts), CELLS, kind, counts)


@query("M3_linear_vector_joined", _M3, ctes=_CELL_INDEX)
def linear_vector_joined(spark, path):
    return features.vector_slots(_joined_vectors(spark, path, "linear"), list(CELLS.dims), nonzero_only=True)


@query("M4_tree_vector_joined", _M4, ctes=_CELL_INDEX)
def tree_vector_joined(spark, path):
    return features.vector_slots(_joined_vectors(spark, path, "tree"), list(CELLS.dims))


@query(
    "M5_vector_widths",
    f"""select 'linear' as kind, count(*) + 1 as width, (select count(*) from cells) as vectors from indexed
union all select 'tree', {len(CELLS.dims) + 1}, (select count(*) from cells)""",
    ctes=_CELL_INDEX,
)
def vector_widths(spark, path):
    frames = [
        _vectors(spark, path, kind)
        .select(F.lit(kind).alias("kind"), F.size(features.vector_to_array("features")).cast("long").alias("width"))
        .groupBy("kind", "width")
        .agg(F.count("*").alias("vectors"))
        for kind in ("linear", "tree")
    ]
    return frames[0].unionByName(frames[1])


# Splits -------------------------------------------------------------------------------


@query(
    "L1_split_members",
    f"select {_DIMS}, {bucket_sql(_DIMS, 100)} < 80 as in_train from headcount",
)
def split_members(spark, path):
    return headcount(spark, path).select(*HEADCOUNT.dims, in_training(HEADCOUNT.dims).alias("in_train"))


@query(
    "L1_split_sizes",
    f"""select {bucket_sql(_DIMS, 100)} < 80 as in_train, count(*) as rows, cast(sum(headcount) as bigint) as total
from headcount group by 1""",
)
def split_sizes(spark, path):
    facts = headcount(spark, path).groupBy(in_training(HEADCOUNT.dims).alias("in_train"))
    return facts.agg(F.count("*").alias("rows"), F.sum("headcount").alias("total"))


@query(
    "L6_fold_sizes",
    f"select cast({bucket_sql(_CELL_DIMS, 3, start=9)} as integer) as fold, count(*) as rows from cells group by 1",
)
def folds(spark, path):
    return fold_sizes(cells(spark, path), CELLS.dims)


# Closed-form training -----------------------------------------------------------------


@query(
    "L2_least_squares_line",
    "select round(slope, 6) as slope, round(intercept, 4) as intercept from line",
    ctes=TRAINED,
)
def least_squares_line(spark, path):
    line = closed_form_run(spark, path).models[train.LINEAR].stages[-1]
    found = spark.createDataFrame([(float(line.coefficients[0]), float(line.intercept))], "slope double, intercept double")
    return found.select(*round6("slope"), F.round("intercept", 4).alias("intercept"))


def _group_predictions(spark, path, name, dims):
    """Log-space predictions of a closed-form tree for every training group."""
    run = closed_form_run(spark, path)
    groups = run.test.select(*dims).distinct()
    return run.models[name].transform(groups).select(*dims, F.round("prediction", 6).alias("prediction"))


@query(
    "L3_single_tree_group_means",
    "select term_type, attendance, round(p, 6) as prediction from forest",
    ctes=TRAINED,
)
def forest_groups(spark, path):
    return _group_predictions(spark, path, train.FOREST, FOREST_DIMS)


@query(
    "L4_single_boost_group_means",
    "select campus, faculty_group, round(p, 6) as prediction from boosted",
    ctes=TRAINED,
)
def boosted_groups(spark, path):
    return _group_predictions(spark, path, train.BOOSTED, BOOSTED_DIMS)


_PAIRS = f"select {_CELL_DIMS}, original_label, model, round(final_prediction, 6) as final_prediction from pairs"


def _rounded_pairs(stacked):
    return stacked.select(*CELLS.dims, "original_label", "model", *round6("final_prediction"))


@query("L13_predictions_of_all_models", _PAIRS, ctes=_TEST)
def test_predictions(spark, path):
    return _rounded_pairs(closed_form_run(spark, path).predictions())


@query(
    "J3_predictions_with_actuals",
    f"""select {_CELL_DIMS}, original_label, round(final_prediction, 6) as final_prediction
from pairs where model = '{train.BOOSTED}'""",
    ctes=_TEST,
)
def predictions_with_actuals(spark, path):
    """The label travels through the model with its row; nothing is joined."""
    run = closed_form_run(spark, path)
    scored, columns = apply_models(run.test, run.spec, {train.BOOSTED: run.models[train.BOOSTED]})
    prediction = F.round(columns[train.BOOSTED], 6).alias("final_prediction")
    return scored.select(*CELLS.dims, "original_label", prediction)


@query(
    "L8_inverse_and_floor",
    f"""select {_CELL_DIMS}, round(p, 6) as prediction, round(greatest(exp(p) - 1, 1.0), 6) as final_prediction
from test join forest using (term_type, attendance)""",
    ctes=_TEST,
)
def inverse_and_floor(spark, path):
    run = closed_form_run(spark, path)
    in_log_space = run.models[train.FOREST].transform(run.test)
    back = functions.count_prediction(F.col("prediction"))
    return in_log_space.select(
        *CELLS.dims, *round6("prediction"), F.round(back, 6).alias("final_prediction")
    )


@query(
    "L13_calibration_bins",
    """select model, cast(floor(final_prediction / 50) as bigint) as bin, count(*) as rows,
  round(avg(final_prediction), 6) as mean_predicted, round(avg(original_label), 6) as mean_actual
from pairs group by 1, 2""",
    ctes=_TEST,
)
def calibration_bins(spark, path):
    bins = metrics.calibration(closed_form_run(spark, path).predictions(), width=50)
    return bins.select("model", "bin", "rows", *round6("mean_predicted", "mean_actual"))


@query("L7_metrics", _METRICS, ctes=_TEST)
def test_metrics(spark, path):
    run = closed_form_run(spark, path)
    scored, columns = apply_models(run.test, run.spec, run.models)
    return metrics.regression_metrics(scored, columns).select("model", *round6("rmse", "r2", "mae"))


_COMPARED = f"select *, r2 = max(r2) over () as is_best from ({_METRICS})"


@query("L9_train_and_measure", _COMPARED, ctes=_TEST)
def train_and_measure(spark, path):
    """A whole training run of its own: split, fit three models, measure, pick the best."""
    run = train.train(cells(spark, path), WEIGHTED, closed_form_models(), parallelism=4)
    return run.metrics.select("model", *round6("rmse", "r2", "mae"), "is_best")


@query("L10_model_comparison", _COMPARED, ctes=_TEST)
def model_comparison(spark, path):
    return closed_form_run(spark, path).metrics.select("model", *round6("rmse", "r2", "mae"), "is_best")


_BEST = "select arg_max(model, r2) as model from measured"


@query("K4_best_model", _BEST, ctes=_TEST)
def best_model(spark, path):
    return metrics.best_model(closed_form_run(spark, path).metrics)


# Permutation importance -----------------------------------------------------------------

_PERMUTED = f"""{TRAINED},
test as (select *, row_number() over (order by {_CELL_DIMS}) as nth from labelled where not in_train),
dealt as ({" union all ".join(
    f"select '{d}' as feature, {d} as permuted, row_number() over (order by md5(concat_ws(chr(31), '42', '{d}', {_CELL_DIMS})), {_CELL_DIMS}) as nth from test"
    for d in CELLS.dims)}),
variants as (
  select cast(null as varchar) as feature, {_CELL_DIMS}, original_label from test
  union all select feature, {", ".join(f"case when feature = '{d}' then permuted else {d} end as {d}" for d in CELLS.dims)}, original_label
  from test join dealt using (nth)),
errors as (
  select model, feature, sqrt(avg((original_label - final_prediction) ** 2)) as rmse
  from ({predictions_sql("variants", "feature, original_label")}) group by model, feature),
importances as (
  select e.model, e.feature, round(e.rmse, 6) as rmse, round(e.rmse - w.rmse, 6) + 0.0 as importance
  from errors e join errors w on e.model = w.model and w.feature is null where e.feature is not null)"""


def _permutation_importance(spark, path):
    run = closed_form_run(spark, path)
    found = permutation_importance(run.test, CELLS, run.models)
    return found.select("model", "feature", F.round("rmse", 6).alias("rmse"), (F.round("importance", 6) + F.lit(0.0)).alias("importance"))


@query("L12_permutation_importance", "select * from importances", ctes=_PERMUTED)
def importance_of_features(spark, path):
    """Errors of the closed-form models with each dimension permuted."""
    return _permutation_importance(spark, path)


@query(
    "K3_permutation_importance_ascending",
    "select model, feature, cast(row_number() over (partition by model order by importance, feature) as integer) as place from importances",
    ctes=_PERMUTED,
)
def importance_ascending(spark, path):
    """Features of each model, least important first."""
    found = _permutation_importance(spark, path).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("importance", "feature"))).alias("all"))
    return found.select("model", F.posexplode("all").alias("at", "f")).select("model", "f.feature", (F.col("at") + 1).alias("place"))


# Saved models -------------------------------------------------------------------------


def _saved(spark, path) -> str:
    run = closed_form_run(spark, path)
    root = scratch_path(spark, "models")
    registry.save_run(run.models, run.metrics, root)
    return root


def _registry_rows(rows):
    folder = F.regexp_extract("path", "[^/]+$", 0).alias("folder")
    return rows.select("model", folder, *round6("rmse", "r2", "mae"), "is_best")


@query("S3_saved_models_predict", _PAIRS, ctes=_TEST)
def saved_models_predict(spark, path):
    """Predictions of models that were saved and loaded again."""
    models, _ = registry.load_models(registry.read_registry(spark, _saved(spark, path)))
    run = closed_form_run(spark, path)
    return _rounded_pairs(stack_predictions(*apply_models(run.test, run.spec, models)))


@query("S5_latest_run_wins", _REGISTRY, ctes=_TEST)
def latest_run_wins(spark, path):
    """An older run with other figures and a half-finished newer one do not show."""
    run = closed_form_run(spark, path)
    root = scratch_path(spark, "models")
    older = run.metrics.withColumns({"rmse": F.lit(0.0), "r2": F.lit(1.0)})
    registry.write_registry(older, root, "20000101")
    registry.save_run(run.models, run.metrics, root)
    run.models[train.LINEAR].write().save(f"{root}/runs/99990101/{registry.model_folder(train.LINEAR)}")
    return _registry_rows(registry.read_registry(spark, root))


@query("L11_best_saved_model", _BEST, ctes=_TEST)
def best_saved_model(spark, path):
    """The best model as a reader of the saved registry sees it."""
    saved = registry.read_registry(spark, _saved(spark, path))
    return saved.filter("is_best").select("model")


@query(
    "W3_chosen_model",
    f"""select 'no name' as requested, arg_max(model, r2) as chosen from measured
union all select model, model from measured""",
    ctes=_TEST,
)
def chosen_model(spark, path):
    saved = registry.read_registry(spark, _saved(spark, path))
    names = [None, train.LINEAR, train.FOREST, train.BOOSTED]
    rows = [(name or "no name", registry.choose_model(saved, name)[0]) for name in names]
    return spark.createDataFrame(rows, "requested string, chosen string")


@query("S6_registry_written", _REGISTRY, ctes=_TEST)
def registry_written(spark, path):
    root = scratch_path(spark, "registry")
    registry.write_registry(closed_form_run(spark, path).metrics, root, registry.new_run_id())
    return _registry_rows(registry.read_registry(spark, root))


@query(
    "S7_registry_document",
    """select (select arg_max(model, r2) from measured) as best_model, model, round(rmse, 6) as "RMSE",
  round(r2, 6) as "R2", round(mae, 6) as "MAE" from measured""",
    ctes=_TEST,
)
def registry_document(spark, path):
    document = registry.registry_document(registry.read_registry(spark, _saved(spark, path)))
    entries = document.select("best_model", F.explode("models").alias("model", "details"))
    return entries.select("best_model", "model", *(F.round(f"details.{m}", 6).alias(m) for m in ("RMSE", "R2", "MAE")))


@query("S8_loaded_models_measure_the_same", _METRICS, ctes=_TEST)
def loaded_models_measure(spark, path):
    models, _ = registry.load_models(registry.read_registry(spark, _saved(spark, path)))
    run = closed_form_run(spark, path)
    scored, columns = apply_models(run.test, run.spec, models)
    return metrics.regression_metrics(scored, columns).select("model", *round6("rmse", "r2", "mae"))


# The nested document ------------------------------------------------------------------


def _documented(spark, path) -> documents.Document:
    run = closed_form_run(spark, path)
    return documents.save_run(run.models, run.metrics, f"{scratch_path(spark, 'documents')}/models")


_DOCUMENT = """select (select arg_max(model, r2) from measured) as best_model, model,
  concat('models/runs/RUN/', replace(replace(lower(model), ' ', '_'), '-', '_')) as path,
  round(rmse, 6) as "RMSE", round(r2, 6) as "R2", round(mae, 6) as "MAE" from measured"""


@query("S6_nested_document_written", _DOCUMENT, ctes=_TEST)
def nested_document(spark, path):
    """The document as any JSON reader sees it."""
    saved = _documented(spark, path)
    entry = "struct<path:string,RMSE:double,R2:double,MAE:double>"
    text = spark.read.text(f"{saved.root}/metadata.json", wholetext=True)
    read = text.select(F.from_json("value", f"best_model string, models map<string,{entry}>").alias("d"))
    entries = read.select("d.best_model", F.explode("d.models").alias("model", "e"))
    place = F.regexp_replace("e.path", "runs/[^/]+/", "runs/RUN/").alias("path")
    return entries.select("best_model", "model", place, *(F.round(f"e.{m}", 6).alias(m) for m in ("RMSE", "R2", "MAE")))


@query("S7_document_models_in_moved_folder", _METRICS, ctes=_TEST)
def moved_folder(spark, path):
    """The root is moved and renamed; its document still leads to the models."""
    saved = _documented(spark, path)
    target = scratch_path(spark, "moved")
    files = documents._Files(spark, saved.root)
    files.system.rename(files.path(), documents._Files(spark, target).path())
    models, _ = documents.load_models(documents.read_document(spark, target))
    run = closed_form_run(spark, path)
    return metrics.regression_metrics(*apply_models(run.test, run.spec, models)).select("model", *round6("rmse", "r2", "mae"))


@query("S5_old_runs_removed", "select 'current' as run, model, true as loads from measured union all select 'old', model, false from measured", ctes=_TEST)
def old_runs_removed(spark, path):
    """Two published runs and a failed one; all but the last are removed."""
    run = closed_form_run(spark, path)
    root = f"{scratch_path(spark, 'documents')}/models"
    old = documents.save_run(run.models, run.metrics, root, "20000101T000000Z")
    run.models[train.LINEAR].write().save(f"{root}/runs/20010101T000000Z/linear_regression")
    current = documents.save_run(run.models, run.metrics, root)
    documents.remove_old_runs(spark, root, keep=1)
    files = documents._Files(spark, root)
    places = [(label, name, doc.path(name)) for label, doc in (("old", old), ("current", current)) for name in doc.models]
    rows = [(label, name, files.system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/metadata"))) for label, name, place in places]
    return spark.createDataFrame(rows, "run string, model string, loads boolean")


# Tuned models: no closed form ---------------------------------------------------------


@query("L2_elastic_net_tuned")
def elastic_net(spark, path):
    model = tuned_run(spark, path).models[train.LINEAR].stages[-1]
    rows = [(i, float(w)) for i, w in enumerate([*model.coefficients, model.intercept])]
    return spark.createDataFrame(rows, "slot int, weight double")


def _tuned_predictions(spark, path, name):
    run = tuned_run(spark, path)
    scored, columns = apply_models(run.test, run.spec, {name: run.models[name]})
    return stack_predictions(scored, columns).select(*CELLS.dims, "original_label", "model", "final_prediction")


@query("L3_random_forest_tuned")
def random_forest(spark, path):
    return _tuned_predictions(spark, path, train.FOREST)


@query("L4_gradient_boosted_tuned")
def gradient_boosted(spark, path):
    return _tuned_predictions(spark, path, train.BOOSTED)


@query(
    "L5_grid_points",
    f"""select * from (values ('{train.LINEAR}', 2), ('{train.FOREST}', 2), ('{train.BOOSTED}', 2)) as g(model, points)""",
)
def grid_points(spark, path):
    """Settings tried per model in the small search."""
    tried = tuned_run(spark, path).tuning.groupBy("model")
    return tried.agg(F.count("*").cast("int").alias("points"))


_FOLDED = f"""{TRAINED},
folded as (select *, {bucket_sql(_CELL_DIMS, 3, start=9)} as fold from labelled where in_train),
fitted as (
  select held_out, regr_slope(label, numeric_year) as slope, regr_intercept(label, numeric_year) as intercept,
         sum(label * numeric_year) / sum(numeric_year * numeric_year) as slope_only
  from folded join range(3) as f(held_out) on fold <> held_out group by held_out
),
errors as (
  select held_out, sqrt(avg((label - slope * numeric_year - intercept) ** 2)) as with_intercept,
         sqrt(avg((label - slope_only * numeric_year) ** 2)) as without_intercept
  from folded join fitted on fold = held_out group by held_out
)"""


@query(
    "L6_cross_validation",
    """select 'fitIntercept=True' as params, round(avg(with_intercept), 5) as log_rmse from errors
union all select 'fitIntercept=False', round(avg(without_intercept), 5) from errors""",
    ctes=_FOLDED,
)
def cross_validation_errors(spark, path):
    """Three folds and two settings of the least-squares line: six fits and a final one."""
    line = closed_form_models()[0]
    line.grid = train.param_grid(line.estimator, {"fitIntercept": [True, False]})
    run = train.train(cells(spark, path), WEIGHTED, [line])
    return run.tuning.select("params", F.round("log_rmse", 5).alias("log_rmse"))


@query("L6_tuned_cross_validation")
def cross_validation(spark, path):
    return tuned_run(spark, path).tuning


@query("L10_tuned_comparison")
def tuned_comparison(spark, path):
    return tuned_run(spark, path).metrics


def _importance(spark, path, name):
    run = tuned_run(spark, path)
    return train.feature_importance(spark, run.models[name], run.spec)


@query("L12_forest_importance")
def forest_importance(spark, path):
    return _importance(spark, path, train.FOREST)


@query("K3_boosted_importance_ascending")
def boosted_importance(spark, path):
    return _importance(spark, path, train.BOOSTED)
