"""The searches at their full settings, and the sums that linear ones are tuned from.

The reference searches have 9, 2 and 4 settings, 200 trees and 100 rounds of boosting; one run a
model is shared by the queries of a session. Ridge settings are checked exactly: SQL
solves their normal equations by elimination.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.operators import features, metrics
from countcast.plans import elastic_net, train
from countcast.plans.score import apply_models, stack_predictions
from countcast.queries.catalogue import query, unpivot_sql
from countcast.queries.models import _CELL_DIMS, _INDEX, TRAINED, WEIGHTED, bucket_sql
from countcast.sources.star import cells
from countcast.spec import CELLS
from countcast.workspace import stored

NAMES = (train.LINEAR, train.FOREST, train.BOOSTED)
# All fits of a search at once: a fit is a long row of short jobs that leave most cores idle.
FITS_AT_ONCE = 12

_runs: dict[tuple[str, str, str], train.TrainingRun] = {}
_cells: dict[tuple[str, str], DataFrame] = {}


def reference_run(spark, path, name: str) -> train.TrainingRun:
    """The full search of one model: split, folds, all settings, refit, held-out figures."""
    app = spark.sparkContext.applicationId
    if (app, path, name) not in _runs:
        candidate = next(c for c in train.candidates("reference") if c.name == name)
        if (app, path) not in _cells:  # a few thousand rows, summed from all lines once for the three searches
            _cells[app, path] = stored(cells(spark, path), "cells")
        _runs[app, path, name] = train.train(_cells[app, path], WEIGHTED, [candidate], parallelism=FITS_AT_ONCE)
    return _runs[app, path, name]


def reference_runs(spark, path) -> list[train.TrainingRun]:
    """The three searches, side by side."""
    reference_run(spark, path, train.LINEAR)  # the shortest; it stores the cells

    def run(name):
        return reference_run(spark, path, name)

    with ThreadPoolExecutor(len(NAMES)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), NAMES))


def _training_rows(spark, path) -> DataFrame:
    rows = train.prepare(cells(spark, path), WEIGHTED, list(WEIGHTED.dims), train.FOLDS)
    return train.split(rows, list(WEIGHTED.dims), 80)[0]


_SLOTS = f"""{TRAINED},
trained as (select row_number() over () as r, *, {bucket_sql(_CELL_DIMS, 3, start=9)} as fold from labelled where in_train),
{_INDEX.format(rows=unpivot_sql("trained", CELLS.dims))},
numbered as (
  select dimension, value, cast(index + case dimension {" ".join(
    f"when '{d}' then (select count(*) from indexed where dimension in ('', {', '.join(f"'{e}'" for e in CELLS.dims[:i]) or "''"}))"
    for i, d in enumerate(CELLS.dims))} end as integer) as slot from indexed),
filled as materialized ({" union all ".join(
    f"select r, fold, slot, label, numeric_year from trained join numbered on dimension = '{d}' and value = {d}" for d in CELLS.dims)})"""


@query(
    "L2_gram_sums",
    """select cast(fold as integer) as fold, -1 as i, -1 as j, count(*) as rows, round(sum(label), 6) as label, round(sum(label * label), 6) as label2,
  sum(numeric_year) as year, sum(numeric_year * numeric_year) as year2, round(sum(numeric_year * label), 4) as year_label from trained group by fold
union all
select cast(a.fold as integer), a.slot, b.slot, count(*),
  round(sum(case when a.slot = b.slot then a.label end), 6), round(sum(case when a.slot = b.slot then a.label * a.label end), 6),
  sum(case when a.slot = b.slot then a.numeric_year end), sum(case when a.slot = b.slot then a.numeric_year * a.numeric_year end),
  round(sum(case when a.slot = b.slot then a.numeric_year * a.label end), 4)
from filled a join filled b on a.r = b.r and a.slot <= b.slot group by a.fold, a.slot, b.slot""",
    ctes=_SLOTS,
)
def gram_sums(spark, path):
    """Sums of products of all pairs of one-hot columns, the label and the year, by fold."""
    rows = _training_rows(spark, path)
    indexer = features.fit_indexer(rows, WEIGHTED)
    sums = elastic_net.fold_sums(indexer.transform(rows), indexer, WEIGHTED)
    return sums.select(
        "fold", "i", "j", "rows", F.round("label", 6).alias("label"), F.round("label2", 6).alias("label2"),
        "year", "year2", F.round("year_label", 4).alias("year_label"),
    )


_RIDGE = f"""{_SLOTS},
w as (select count(*) as w from numbered),
long as materialized (
  select r, fold, slot as c, cast(1 as double) as v from filled
  union all select r, fold, w, numeric_year from trained, w union all select r, fold, w + 1, 1.0 from trained, w
  union all select r, fold, w + 2, label from trained, w),
products as materialized (
  select a.fold, a.c as i, b.c as j, sum(a.v * b.v) as s from long a join long b using (r) group by 1, 2, 3),
sums as materialized (
  select held, i, j, sum(case when fold <> held then s else 0 end) as s, sum(case when fold = held then s else 0 end) as h
  from products, range(3) as f(held) group by 1, 2, 3),
moments as materialized (
  select a.held, a.i, a.s / n.s as mean, sqrt(b.s / n.s - (a.s / n.s) ** 2) as sd, n.s as n
  from sums a join sums b on b.held = a.held and b.i = a.i and b.j = a.i
  join sums n on n.held = a.held and n.i = n.j join w on a.j = w + 1 and n.i = w + 1),
system as (
  select reg, a.held, a.i, list((coalesce(s.s, 0) / a.n - a.mean * b.mean) / (a.sd * b.sd)
      + case when a.i = b.i then cast(reg as double) / y.sd else 0 end order by b.i) as row
  from moments a join moments b on a.held = b.held left join sums s on s.held = a.held and s.i = a.i and s.j = b.i
  join moments y on y.held = a.held, w, (values ('0.001'), ('0.01'), ('0.1')) as g(reg)
  where a.i <= w and (b.i <= w or b.i = w + 2) and y.i = w + 2 group by reg, a.held, a.i),
solved as (
  with recursive step as (
    select 0 as k, reg, held, i, row from system
    union all
    select k + 1, reg, held, i, case when i = k then list_transform(row, lambda x: x / top_row[k + 1])
      else list_transform(list_zip(row, top_row), lambda z: z[1] - row[k + 1] / top_row[k + 1] * z[2]) end
    from (select *, any_value(row) filter (i = k) over (partition by reg, held) as top_row from step, w where k <= w))
  select reg, held, i, row[-1] as beta from step, w where k = w + 1),
weights as materialized (
  select reg, s.held, s.i, beta * y.sd / m.sd as b from solved s join moments m on m.held = s.held and m.i = s.i
  join moments y on y.held = s.held join w on y.i = w + 2),
lines as materialized (
  select * from weights union all
  select reg, g.held, w + 1, any_value(y.mean) - sum(b * m.mean) from weights g join moments m on m.held = g.held and m.i = g.i
  join moments y on y.held = g.held join w on y.i = w + 2 group by reg, g.held, w
  union all select reg, held, w + 2, -1.0 from (select distinct reg, held from weights), w),
measured as (
  select a.reg, a.held, sqrt(sum(a.b * b.b * h) / (select count(*) from trained where fold = a.held)) as error
  from lines a join lines b on a.reg = b.reg and a.held = b.held join sums s on s.held = a.held and s.i = a.i and s.j = b.i
  group by a.reg, a.held)"""


@query(
    "L6_ridge_fold_errors",
    "select concat('elasticNetParam=0.0, regParam=', reg) as params, cast(held as integer) as fold, round(error, 6) as log_rmse from measured",
    ctes=_RIDGE,
)
def ridge_fold_errors(spark, path):
    """Fold errors of the reference's ridge settings, all from one pass of sums."""
    rows = _training_rows(spark, path)
    indexer = features.fit_indexer(rows, WEIGHTED)
    sums = elastic_net.fold_sums(indexer.transform(rows), indexer, WEIGHTED)
    folds = elastic_net.gathered(sums, elastic_net.width(indexer, WEIGHTED), True)
    linear = train.candidates("reference")[0]
    settings = elastic_net.settings_of(linear.estimator, linear.grid)
    named = [(train.describe_settings(g), s) for g, s in zip(linear.grid, settings) if not s.mix]
    errors = elastic_net.fold_errors(folds, [s for _, s in named])
    found = [(name, fold, e) for (name, _), of_folds in zip(named, errors) for fold, e in zip(sorted(folds), of_folds)]
    return spark.createDataFrame(found, "params string, fold int, log_rmse double").select("params", "fold", F.round("log_rmse", 6).alias("log_rmse"))


@query(
    "L5_settings_by_error",
    """select params, round(avg(error), 6) as log_rmse, cast(rank() over (order by avg(error)) as integer) as place
from (select concat('elasticNetParam=0.0, regParam=', reg) as params, error from measured) group by params""",
    ctes=_RIDGE,
)
def settings_by_error(spark, path):
    """The ridge settings of the full search in the order of their mean fold errors."""
    tuning = reference_run(spark, path, train.LINEAR).tuning.where("params like 'elasticNetParam=0.0%'")
    placed = tuning.agg(F.sort_array(F.collect_list(F.struct("log_rmse", "params"))).alias("all"))  # a row a setting
    places = placed.select(F.posexplode("all").alias("at", "s"))
    return places.select("s.params", F.round("s.log_rmse", 6).alias("log_rmse"), (F.col("at") + 1).alias("place"))


@query("L5_reference_settings")
def reference_settings(spark, path):
    """All 15 settings of the full searches with their mean fold errors."""
    return reduce(DataFrame.unionByName, (run.tuning for run in reference_runs(spark, path)))


@query("L2_elastic_net_reference")
def elastic_net_reference(spark, path):
    """Weights of the best of nine settings, by column."""
    model = reference_run(spark, path, train.LINEAR).models[train.LINEAR].stages[-1]
    rows = [(i, float(w)) for i, w in enumerate([*model.coefficients, model.intercept])]
    return spark.createDataFrame(rows, "slot int, weight double")


def _predictions(spark, path, name):
    run = reference_run(spark, path, name)
    return stack_predictions(*apply_models(run.test, run.spec, run.models)).select(*CELLS.dims, "original_label", "model", "final_prediction")


@query("L3_random_forest_reference")
def forest_reference(spark, path):
    """Held-out predictions of 200 trees, the deeper or shallower ones by fold error."""
    return _predictions(spark, path, train.FOREST)


@query("L4_gradient_boosted_reference")
def boosted_reference(spark, path):
    """Held-out predictions of 100 boosting rounds at the best of four settings."""
    return _predictions(spark, path, train.BOOSTED)


@query("L10_reference_comparison")
def reference_comparison(spark, path):
    """Held-out figures of the three full searches, the best one marked."""
    figures = [run.metrics.drop("is_best") for run in reference_runs(spark, path)]
    return metrics.with_best(reduce(DataFrame.unionByName, figures))
