"""Scoring request tables and streams, scenario grids, what-if summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from countcast.functions import count_prediction, hash_bucket, two_decimals
from countcast.operators import grid, option_tables, options
from countcast.operators.numbering import numbered
from countcast.plans import score, train, whatif
from countcast.queries.catalogue import query, round6, unpivot_sql
from countcast.queries.models import (
    _TEST,
    TRAINED,
    WEIGHTED,
    closed_form_run,
    predictions_sql,
    tuned_run,
)
from countcast.queries.profiles import REQUEST_ID_SQL
from countcast.sources import documents
from countcast.sources.star import headcount, order_lines, table
from countcast.spec import CELLS, HEADCOUNT, SUMMARY_DIMS, CountSpec
from countcast.streaming import (
    answer_stream,
    current_means,
    current_totals,
    fact_stream,
    mean_measures,
    request_stream,
    score_stream,
    start_scoring,
    start_totals,
    total_measures,
    unique_requests,
)
from countcast.workspace import scratch_path

_DIMS = ", ".join(HEADCOUNT.dims)
_CELL_DIMS = ", ".join(CELLS.dims)
# Requests carry all twelve dimensions; the model uses those it was trained on.
ALL_DIMS = HEADCOUNT

_REQUESTS = f"""{TRAINED},
requests as (select {REQUEST_ID_SQL.format(keys=_DIMS)}, {_DIMS} from headcount),
replies as ({predictions_sql("requests", f"request_id, {_DIMS}")})"""


_numbered_facts = {}


def _facts(spark, path):
    """The fact table with request numbers, one per session and data folder. The queries that score
    take requests and training counts from it, so that the lines are joined once."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _numbered_facts:
        _numbered_facts[key] = numbered(headcount(spark, path), HEADCOUNT.dims, "request_id")
    return _numbered_facts[key]


def _requests(spark, path):
    return _facts(spark, path).select("request_id", *HEADCOUNT.dims)


def _closed_form(spark, path):
    return closed_form_run(spark, path, _facts(spark, path))


def _tuned(spark, path):
    return tuned_run(spark, path, _facts(spark, path))


def _best(run):
    return score.Predictor(ALL_DIMS, run.models, run.best)


_BEST_MODEL = f"""(select model from (
  select model, avg((original_label - final_prediction) ** 2) as mse from (
    {predictions_sql("(select * from labelled where not in_train)", "original_label")}
  ) group by model) order by mse limit 1)"""
_BEST_REPLIES = f"""select request_id, {_DIMS}, round(final_prediction, 2) as predicted_headcount
from replies where model = {_BEST_MODEL}"""


@query("W2_score_request_table", _BEST_REPLIES, ctes=_REQUESTS)
def score_request_table(spark, path):
    return _best(_closed_form(spark, path)).predict_table(_requests(spark, path))


@query(
    "F4_echo_of_inputs",
    f"select {_DIMS}, round(final_prediction, 6) as final_prediction from replies where model = '{train.BOOSTED}'",
    ctes=_REQUESTS,
)
def echo_of_inputs(spark, path):
    model = _closed_form(spark, path).models[train.BOOSTED]
    scored = score.score(_requests(spark, path), ALL_DIMS, model)
    return scored.select(*HEADCOUNT.dims, *round6("final_prediction"))


@query(
    "X6_two_decimals",
    "select l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice / 7, 2) as rounded from lineitem",
)
def rounded_to_cents(spark, path):
    rounded = two_decimals(F.col("l_extendedprice") / 7).alias("rounded")
    return table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", rounded)


@query(
    "W3_named_model",
    f"""select request_id, {_DIMS}, round(final_prediction, 2) as predicted_headcount
from replies where model = '{train.FOREST}'""",
    ctes=_REQUESTS,
)
def named_model(spark, path):
    return _best(_closed_form(spark, path)).predict_table(_requests(spark, path), train.FOREST)


@query("K5_replies_in_request_order", _BEST_REPLIES, ctes=_REQUESTS)
def replies_in_order(spark, path):
    ordered = score.in_request_order(_requests(spark, path))
    return _best(_closed_form(spark, path)).predict_table(ordered)


@query("S9_replies_written", _BEST_REPLIES, ctes=_REQUESTS)
def replies_written(spark, path):
    replies = _best(_closed_form(spark, path)).predict_table(_requests(spark, path))
    target = scratch_path(spark, "replies")
    replies.write.parquet(target)
    return spark.read.schema(replies.schema).parquet(target)


@query(
    "W1_score_one_request",
    f"""select {_BEST_MODEL} as model, round(final_prediction, 2) as predicted_headcount from replies
where model = {_BEST_MODEL} order by request_id limit 1""",
    ctes=_REQUESTS,
)
def score_one_request(spark, path):
    first = _requests(spark, path).orderBy("request_id").first().asDict()
    return _best(_closed_form(spark, path)).predict(spark, first)


@query("W1_tuned_model_one_request")
def tuned_one_request(spark, path):
    first = _requests(spark, path).orderBy("request_id").first().asDict()
    return _best(_tuned(spark, path)).predict(spark, first)


@query("W2_tuned_model_request_table")
def tuned_request_table(spark, path):
    return _best(_tuned(spark, path)).predict_table(_requests(spark, path))


@query(
    "U1_stacked_predictions",
    f"select request_id, {_DIMS}, model, round(final_prediction, 6) as final_prediction from replies",
    ctes=_REQUESTS,
)
def stacked_predictions(spark, path):
    stacked = score.score_models(_requests(spark, path), ALL_DIMS, _closed_form(spark, path).models)
    return stacked.select("request_id", *HEADCOUNT.dims, "model", *round6("final_prediction"))


# Requests with faults: no campus for year 1997/98, malformed years for attendance P.
_FAULTY = f"""requests as (
  select request_id, {_DIMS.replace("campus", "nullif(campus, case when fiscal_year = '1997/98' then campus end) as campus").replace("fiscal_year,", "case when attendance = 'P' then concat('FY', fiscal_year) else fiscal_year end as fiscal_year,", 1)}
  from (select {REQUEST_ID_SQL.format(keys=_DIMS)}, * from headcount))"""


def _faulty(spark, path):
    year, campus = F.col("fiscal_year"), F.col("campus")
    return _requests(spark, path).withColumns(
        {
            "campus": F.when(year != "1997/98", campus),
            "fiscal_year": F.when(F.col("attendance") == "P", F.concat(F.lit("FY"), year)).otherwise(year),
        }
    )


@query(
    "X1_rejected_requests",
    """select request_id, case when campus is null then 'missing campus' else 'malformed year' end as reason
from requests where campus is null or try_cast(substr(fiscal_year, 1, 4) as double) is null""",
    ctes=_FAULTY,
)
def rejected_requests(spark, path):
    return score.rejected_requests(_faulty(spark, path), ALL_DIMS).select("request_id", "reason")


_STRANGE = ("NaN", "9e99", " ", "20a6/27", "1998/99")


def _strange(spark, path):
    """Requests of which those of each study year have another kind of year, one of them good."""
    kind = F.element_at(F.array(*map(F.lit, _STRANGE)), F.substring("study_year", 1, 1).try_cast("int"))
    return _faulty(spark, path).withColumn("fiscal_year", F.coalesce(kind, F.col("fiscal_year")))


_STRANGE_SQL = f"""faulty as (select * from ({_FAULTY.removeprefix("requests as (")}),
asked as (select * replace (coalesce({list(_STRANGE)!r}[try_cast(substr(study_year, 1, 1) as integer)], fiscal_year) as fiscal_year) from faulty),
requests as (select *, case when campus is null then 'missing campus' when not regexp_matches(fiscal_year, '^[0-9]{{4}}') then 'malformed year' end as reason from asked)"""
_ANSWERS = f"""select request_id, case when reason is null then round(final_prediction, 2) end as predicted_headcount, reason
from ({predictions_sql("requests", "request_id, reason")}) where model = '{train.FOREST}'""".replace(
    "cast(substr(fiscal_year, 1, 4) as double) + intercept", "try_cast(substr(fiscal_year, 1, 4) as double) + intercept"
)


@query("W2_every_request_answered", _ANSWERS, ctes=f"{TRAINED},{_STRANGE_SQL}")
def every_request_answered(spark, path):
    replies = _best(_closed_form(spark, path)).answer_table(_strange(spark, path), train.FOREST)
    return replies.select("request_id", "predicted_headcount", "reason")


@query("T1_stream_with_rejects", _ANSWERS, ctes=f"{TRAINED},{_STRANGE_SQL}")
def stream_with_rejects(spark, path):
    """The faulty requests arriving as files: the stream answers each and goes on."""
    inbox, output, checkpoint = (scratch_path(spark, f"faulty-{part}") for part in ("in", "out", "state"))
    _strange(spark, path).write.parquet(inbox)
    run = _closed_form(spark, path)
    replies = answer_stream(request_stream(spark, inbox, ALL_DIMS), ALL_DIMS, run.models[train.FOREST])
    start_scoring(replies, output, checkpoint, once=True).awaitTermination()
    return spark.read.schema(replies.schema).parquet(output).select("request_id", "predicted_headcount", "reason")


@query(
    "X4_valid_requests_scored",
    f"""select request_id, round(final_prediction, 2) as predicted_headcount
from ({predictions_sql("requests", "request_id, campus, fiscal_year")})
where model = '{train.FOREST}' and campus is not null and try_cast(substr(fiscal_year, 1, 4) as double) is not null""".replace(
        "cast(substr(fiscal_year, 1, 4) as double) + intercept",
        "try_cast(substr(fiscal_year, 1, 4) as double) + intercept",
    ),
    ctes=f"{TRAINED},{_FAULTY}",
)
def valid_requests_scored(spark, path):
    replies = _best(_closed_form(spark, path)).predict_table(_faulty(spark, path), train.FOREST)
    return replies.select("request_id", "predicted_headcount")


@query(
    "X4_inverse_of_log",
    """select l_orderkey, l_linenumber, l_extendedprice, round(exp(l_quantity / 10) - 1, 6) as back from lineitem""",
)
def inverse_of_log(spark, path):
    back = F.round(F.expm1(F.col("l_quantity") / 10), 6).alias("back")
    return table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", back)


@query(
    "X5_floor_of_one",
    """select l_orderkey, l_linenumber, l_extendedprice,
  round(greatest(exp(l_quantity / 10 - 1) - 1, 1.0), 6) as final_prediction from lineitem""",
)
def floor_of_one(spark, path):
    """Quantities as if they were log-space predictions; small ones meet the floor."""
    back = F.round(count_prediction(F.col("l_quantity") / 10 - 1), 6).alias("final_prediction")
    return table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", back)


@query(
    "F5_unknown_model_names",
    """select distinct o_orderpriority as model from orders
where o_orderpriority not in ('5-LOW') and o_orderstatus = 'P'""",
)
def unknown_model_names(spark, path):
    """Requested names (here: order priorities) against a registry listing one of them."""
    orders = table(spark, path, "orders")
    names = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("model")).distinct()
    listed = orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderpriority").alias("model")).distinct()
    return score.unknown_models(names, listed)


@query(
    "F5_unknown_models_of_a_registry",
    "select model from (values ('Random Forest'), ('Nearest Neighbours'), ('linear regression')) as asked(model) where model not in (select model from measured)",
    ctes=_TEST,
)
def unknown_models_of_a_registry(spark, path):
    """Requested names against the models of a published run."""
    run = closed_form_run(spark, path)
    saved = documents.save_run(run.models, run.metrics, f"{scratch_path(spark, 'documents')}/models")
    names = spark.createDataFrame([("Random Forest",), ("Nearest Neighbours",), ("linear regression",)], "model string")
    return score.unknown_models(names, documents.read_document(spark, saved.root).table(spark))


@query("F6_empty_batch", f"select request_id, {_DIMS}, cast(0 as double) as predicted_headcount from requests where false", ctes=_REQUESTS)
def empty_batch(spark, path):
    """No request matches; the answer is empty even though no such model exists."""
    none = _requests(spark, path).filter("campus = 'ATLANTIS'")
    return _best(_closed_form(spark, path)).predict_table(none, "No Such Model")


_STREAM = """select request_id, round(final_prediction, 2) as predicted_headcount
from replies where model = {best}"""


@query("T1_request_stream_scored", _STREAM.format(best=_BEST_MODEL), ctes=_REQUESTS)
def request_stream_scored(spark, path):
    """Requests arriving as files, scored by a stream that drains them and stops."""
    inbox, output, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    _requests(spark, path).write.parquet(inbox)
    run = _closed_form(spark, path)
    replies = score_stream(request_stream(spark, inbox, ALL_DIMS), ALL_DIMS, run.models[run.best])
    job = start_scoring(replies, output, checkpoint, once=True)
    job.awaitTermination()
    return spark.read.schema(replies.schema).parquet(output).select("request_id", "predicted_headcount")


@query("T1_requests_sent_twice", _STREAM.format(best=_BEST_MODEL), ctes=_REQUESTS)
def requests_sent_twice(spark, path):
    """All requests are sent, and every third again after a restart: each has one reply."""
    inbox, output, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    run = _closed_form(spark, path)
    sent = _requests(spark, path).withColumn("sent_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_id") % 600))

    def drain():
        once = unique_requests(request_stream(spark, inbox, ALL_DIMS, timed=True))
        start_scoring(score_stream(once, ALL_DIMS, run.models[run.best]), output, checkpoint, once=True).awaitTermination()

    sent.write.parquet(inbox)
    drain()
    sent.where("request_id % 3 = 0").write.mode("append").parquet(inbox)
    drain()
    return spark.read.parquet(output).select("request_id", "predicted_headcount")


@query(
    "A9_totals_of_appended_facts",
    f"""select dimension, value, cast(sum(headcount) as bigint) as total, count(*) as records
from ({unpivot_sql("headcount", HEADCOUNT.dims, "headcount")}) group by 1, 2""",
)
def totals_of_appended_facts(spark, path):
    """Facts arrive in three parts; after each, only the new ones are read."""
    inbox, target, checkpoint = (scratch_path(spark, f"totals-{part}") for part in ("in", "out", "state"))
    facts = headcount(spark, path).withColumn("part", hash_bucket(HEADCOUNT.dims, 3))
    facts.write.partitionBy("part").parquet(stage := scratch_path(spark, "parts"))
    for part in range(3):
        spark.read.parquet(f"{stage}/part={part}").write.mode("append").parquet(inbox)
        start_totals(fact_stream(spark, inbox, HEADCOUNT), HEADCOUNT.dims, total_measures(HEADCOUNT), target, checkpoint, once=True).awaitTermination()
    return current_totals(spark, target, ["total", "records"])


@query(
    "A11_means_of_a_scored_stream",
    "select dimension, value, floor(sum(cast(round(cents * 100) as bigint)) / count(*) + 0.5) / 100 as headcount from ("
    + unpivot_sql("scored", CELLS.dims, "cents")
    + ") group by all",
    ctes=f"{_REQUESTS}, scored as (select *, round(final_prediction, 2) as cents from replies where model = '{train.FOREST}')",
)
def means_of_a_scored_stream(spark, path):
    """Requests are scored as they arrive; their means by dimension are kept up to date."""
    inbox, target, checkpoint = (scratch_path(spark, f"means-{part}") for part in ("in", "out", "state"))
    model = _closed_form(spark, path).models[train.FOREST]
    for part in range(2):
        _requests(spark, path).where(f"request_id % 2 = {part}").write.mode("append").parquet(inbox)
        scored = score.score(request_stream(spark, inbox, ALL_DIMS), ALL_DIMS, model)
        start_totals(scored, CELLS.dims, mean_measures("final_prediction"), target, checkpoint, once=True).awaitTermination()
    return current_means(spark, target)


# Scenario grids -----------------------------------------------------------------------

# Two dimensions narrowed, one cleared, the others open.
SCENARIO = {"fiscal_year": ["1996/97", "1998/99"], "term_type": ["Winter term", "Fall term"], "attendance": []}

_SCENARIO = f"""options as (select distinct dimension, value from ({unpivot_sql("cells", CELLS.dims)})),
grid as (
  select row_number() over (order by y.n, t.n, c.value, f.value, a.value) - 1 as request_id,
         y.value as fiscal_year, t.value as term_type, c.value as campus, f.value as faculty_group,
         a.value as attendance
  from (values (1, '1996/97'), (2, '1998/99')) as y(n, value), (values (1, 'Winter term'), (2, 'Fall term')) as t(n, value),
       (select value from options where dimension = 'campus') c,
       (select value from options where dimension = 'faculty_group') f,
       (select min(value) as value from options where dimension = 'attendance') a
)"""
_GRID = f"""{TRAINED},{_SCENARIO},
replies as (select *, round(final_prediction, 2) as cents from ({predictions_sql("grid", f"request_id, {_CELL_DIMS}")}))"""


def _lists(spark, path, spec=CELLS, scenario=SCENARIO):
    return options.scenario_lists(options.option_catalogue(order_lines(spark, path), spec), spec, scenario)


def _scored_grid(spark, path, run):
    return score.apply_models(grid.scenario_grid(spark, _lists(spark, path)), CELLS, run.models)


@query("J1_scenario_grid", f"select request_id, {_CELL_DIMS} from grid", ctes=_SCENARIO)
def scenario_grid(spark, path):
    return grid.scenario_grid(spark, _lists(spark, path))


_PRODUCT = """select cast(product(n) as bigint) as combinations from (
  select dimension, count(distinct value) as n from ({rows}) group by 1)"""


@query("J2_combination_count", _PRODUCT.format(rows=unpivot_sql("headcount", HEADCOUNT.dims)))
def combination_count(spark, path):
    """The size of the full twelve-dimension grid, without building it."""
    lists = _lists(spark, path, HEADCOUNT, {})
    return spark.createDataFrame([(grid.combination_count(lists),)], "combinations bigint")


@query(
    "F7_combination_limit",
    f"select combinations, combinations > 100000 as refused from ({_PRODUCT.format(rows=unpivot_sql('headcount', HEADCOUNT.dims))})",
)
def combination_limit(spark, path):
    lists = _lists(spark, path, HEADCOUNT, {})
    try:
        grid.check_combinations(lists)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(grid.combination_count(lists), refused)], "combinations bigint, refused boolean")


@query(
    "J1_full_nine_dimension_grid",
    """select count(*) as rows, count(distinct request_id) as ids, min(request_id) as first_id, max(request_id) as last_id
from (select row_number() over () - 1 as request_id from """
    + ", ".join(f"(select distinct {d} from headcount) as {d}_values" for d in SUMMARY_DIMS)
    + ")",
)
def full_grid(spark, path):
    """Every combination of nine dimensions, over the limit for one request; lifted here."""
    lists = _lists(spark, path, HEADCOUNT.with_dims(*SUMMARY_DIMS), {})
    built = grid.scenario_grid(spark, lists, limit=None)
    distinct = built.groupBy(*SUMMARY_DIMS).agg(F.min("request_id").alias("request_id"))
    return distinct.agg(
        F.count("*").alias("rows"),
        F.count("request_id").alias("ids"),
        F.min("request_id").alias("first_id"),
        F.max("request_id").alias("last_id"),
    )


_MEAN = "floor(sum(cast(round(cents * 100) as bigint)) / count(*) + 0.5) / 100"


@query("A10_mean_by_year", f"select fiscal_year as name, {_MEAN} as headcount from replies where model = '{train.LINEAR}' group by 1", ctes=_GRID)
def mean_by_year(spark, path):
    scored, columns = _scored_grid(spark, path, closed_form_run(spark, path))
    return whatif.mean_by(scored, "fiscal_year", columns[train.LINEAR])


@query(
    "A11_means_of_all_dimensions",
    f"select model, dimension, value, {_MEAN} as headcount from ("
    + unpivot_sql("replies", CELLS.dims, "model, cents")
    + ") group by all",
    ctes=_GRID,
)
def means_of_all_dimensions(spark, path):
    scored, columns = _scored_grid(spark, path, closed_form_run(spark, path))
    return whatif.mean_by_dimensions(scored, CELLS, CELLS.dims, columns)


_MODELS = f"select model, {_MEAN} as headcount from replies group by 1"


@query("A12_mean_by_model", _MODELS, ctes=_GRID)
def mean_by_model(spark, path):
    scored, columns = _scored_grid(spark, path, closed_form_run(spark, path))
    return whatif.compare_models(scored, columns)


@query("W5_model_comparison", _MODELS, ctes=_GRID)
def model_comparison(spark, path):
    """Stacked predictions of all models over the grid, averaged per model."""
    scored = grid.scenario_grid(spark, _lists(spark, path))
    stacked = score.score_models(scored, CELLS, closed_form_run(spark, path).models)
    return whatif.mean_by(stacked, "model").withColumnRenamed("name", "model")


_W4 = (
    f"select model, dimension, value, {_MEAN} as headcount from ("
    + unpivot_sql("replies", [d for d in SUMMARY_DIMS if d in CELLS.dims], "model, cents")
    + f""") where model = {_BEST_MODEL} group by all
union all select model, null, null, {_MEAN} from replies group by model"""
)


@query("W4_what_if_report", _W4, ctes=_GRID)
def what_if_report(spark, path):
    run = closed_form_run(spark, path)
    return whatif.what_if(spark, _lists(spark, path), CELLS, run.models, run.best)


@query("W4_tuned_what_if_report")
def tuned_what_if_report(spark, path):
    run = tuned_run(spark, path)
    return whatif.what_if(spark, _lists(spark, path, CELLS, {}), CELLS, run.models, run.best)


# Selections kept as tables --------------------------------------------------------------


def _ranked(spark, path, spec=CELLS, scenario=SCENARIO):
    rows = [(d, v, i) for d, values in scenario.items() for i, v in enumerate(values)]
    chosen = spark.createDataFrame(rows, option_tables.SELECTION)
    cleared = [d for d, values in scenario.items() if not values]
    catalogue = options.option_catalogue(order_lines(spark, path), spec)
    return option_tables.RankedOptions(option_tables.resolved(catalogue, spec, chosen, cleared), spec)


@query("J1_grid_from_option_tables", f"select request_id, {_CELL_DIMS} from grid", ctes=_SCENARIO)
def grid_from_option_tables(spark, path):
    """Digits of request numbers joined with ranked options."""
    return _ranked(spark, path).grid()


@query(
    "J1_grid_of_many_options",
    """select count(*) as rows, count(distinct request_id) as ids, max(request_id) as last_id, count(distinct orderkey) as orders,
  sum(cast(orderkey as bigint)) as keys from (
  select row_number() over () - 1 as request_id, orderkey from (select distinct cast(o_orderkey as varchar) as orderkey from orders),
    (select distinct o_orderstatus from orders), (select distinct o_orderpriority from orders))""",
)
def grid_of_many_options(spark, path):
    """A dimension with an option for every order, next to two short ones."""
    spec = CountSpec(("status", "orderkey", "priority"), year_dim=None)
    orders = table(spark, path, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("orderkey"), F.col("o_orderpriority").alias("priority")
    )
    ranked = option_tables.RankedOptions(options.option_catalogue(orders, spec), spec)
    rows = ranked.grid(limit=None)
    # rows are counted by order and numbers as bits of words: several distinct counts in one
    # aggregate would keep an entry for each row and count
    by_order = rows.groupBy("orderkey").agg(F.count("*").alias("n"), F.max("request_id").alias("last_id"))
    bit = F.expr("shiftleft(1L, cast(request_id % 64 as int))")
    words = rows.groupBy(F.expr("request_id div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    totals = by_order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("last_id").alias("last_id"), F.count("orderkey").alias("orders"),
        F.sum(F.col("orderkey").cast("bigint") * F.col("n")).alias("keys"),
    )
    ids = words.agg(F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0)).alias("ids"))
    # two tables of one row each; a product of them would be a nested loop
    both = totals.unionByName(ids, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("rows", "ids", "last_id", "orders", "keys")))


@query(
    "J2_F7_size_from_counts",
    f"""select cast(cast(product(n) as bigint) as varchar) as combinations, round(sum(log10(n)), 9) as log10_combinations, product(n) > 100000 as refused from (
  select dimension, count(distinct value) as n from ({unpivot_sql('headcount', HEADCOUNT.dims)}) group by 1)""",
)
def size_from_counts(spark, path):
    """The size of the twelve-dimension grid: a product and a sum of logarithms of counts."""
    size = _ranked(spark, path, HEADCOUNT, {}).size()
    return size.withColumn("log10_combinations", F.round("log10_combinations", 9))


@query("W4_report_from_option_tables", _W4, ctes=_GRID)
def report_from_option_tables(spark, path):
    run = closed_form_run(spark, path)
    return whatif.what_if_tables(_ranked(spark, path), run.models, run.best)
