"""Dense numbers and joined category indexes: complete, in order, and the same for any layout."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from countcast import CountSpec
from countcast.operators import category_index as joined
from countcast.operators import features, numbering
from countcast.sources.facts import read_unnumbered_requests, request_table
from countcast.sources.star import cells
from countcast.spec import CELLS
from tests.conftest import SMALL


def numbers(df, name="number"):
    return sorted(r[name] for r in df.collect())


def test_numbers_follow_the_order_and_not_the_layout(spark):
    rows = [(k % 5, None if k % 7 == 0 else f"v{k % 11}", float(k)) for k in range(400)]
    table = spark.createDataFrame(rows, "g int, v string, x double")
    expected = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for layout in (table, table.repartition(9), table.coalesce(1).orderBy(F.rand(3))):
        found = numbering.numbered(layout, ["g", "v"], "number").orderBy("number").collect()
        assert [r.number for r in found] == list(range(400))
        assert [tuple(r)[:3] for r in found] == expected


def test_numbers_of_groups_start_at_zero(spark):
    table = spark.range(300).select((F.col("id") % 4).cast("string").alias("g"), (F.col("id") * 37 % 300).alias("x"))
    table = table.union(spark.createDataFrame([(None, 5), (None, 6)], "g string, x bigint"))
    for r in numbering.numbered(table, ["g", F.desc("x")], "n", groups=["g"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x", "n")), False).alias("all")).collect():
        assert [e["n"] for e in r["all"]] == list(range(len(r["all"])))


def test_equal_rows_are_spread_and_numbered_apart(spark):
    same = spark.range(40_000).select(F.lit("x").alias("v"))
    found = numbering.numbered(same, ["v"], "number")
    assert found.agg(F.countDistinct("number"), F.max("number")).first() == (40_000, 39_999)
    assert found.where("number is not null").rdd.getNumPartitions() >= 1
    assert numbers(numbering.numbered(same.limit(0), ["v"], "number")) == []


def test_columns_that_cannot_be_sorted_travel_along(spark):
    table = spark.createDataFrame([(2, {"a": 1}), (1, {"b": 2})], "k int, m map<string,int>")
    assert [(r["k"], r["a.b"]) for r in numbering.numbered(table, ["k"], "a.b").orderBy("k").collect()] == [(1, 0), (2, 1)]


def test_stored_rows_are_numbered_in_their_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5_000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    table = spark.read.parquet(path)
    assert numbering.numbered_as_stored(table, "n").where("n <> id").isEmpty()
    left = numbering.numbered_as_stored(table.where("id % 3 = 1"), "n")
    assert numbers(left, "n") == list(range(left.count()))
    plan = numbering.numbered_as_stored(table, "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("format", ["json", "csv", "parquet"])
def test_requests_without_numbers_get_their_place(spark, tmp_path, format):
    spec = CountSpec(("d", "e"), year_dim=None)
    path = str(tmp_path / format)
    table = spark.range(999).select(F.lpad("id", 4, "0").alias("d"), F.lit("x|y").alias("e"))
    writer = table.repartitionByRange(3, "d").sortWithinPartitions("d").write
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits to a file
    try:
        found = read_unnumbered_requests(spark, path, spec, format)
        assert found.columns == ["request_id", "d", "e"] and found.where("request_id <> cast(d as bigint)").isEmpty()
        assert found.count() == 999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_request_tables_are_dense_and_keys_are_not_confused(spark):
    spec = CountSpec(("a", "b"), year_dim=None)
    facts = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), ("x", "y|z"), ("x", None)], "a string, b string")
    found = request_table(facts, spec).orderBy("request_id").collect()
    assert [tuple(r) for r in found] == [(0, "x", None), (1, "x", "y|z"), (2, "x|y", "z")]


def test_joined_index_equals_the_indexer(spark, facts, spec):
    known = features.with_year(facts, spec)
    index = joined.category_index(known, spec)
    expected = features.label_table(known, features.fit_features(known, spec, "tree"))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, expected.collect()))
    counts = joined.label_counts(index, spec)
    strange = known.withColumns({"faculty_group": F.when(F.col("faculty_group") != "ENG", F.col("faculty_group")).otherwise("NEW")})
    got = joined.with_vectors(joined.with_category_index(strange, spec, index, counts).where("numeric_year is not null"), spec, "linear", counts)
    model = features.fit_features(known, spec, "linear")
    want = model.transform(strange.where("numeric_year is not null"))
    assert sorted(map(repr, (r.features for r in got.collect()))) == sorted(map(repr, (r.features for r in want.collect())))
    assert joined.category_index(known, CountSpec((), "headcount", None)).isEmpty()


def test_models_fit_on_joined_vectors(spark):
    facts = features.with_labels(cells(spark, SMALL), CELLS)
    index = joined.category_index(facts, CELLS)
    counts = joined.label_counts(index, CELLS)
    indexed = joined.with_category_index(facts, CELLS, index, counts)
    tree = RandomForestRegressor(numTrees=2, maxDepth=3, maxBins=32, seed=1).fit(joined.with_vectors(indexed, CELLS, "tree", counts))
    assert "in {" in tree.toDebugString  # indexes are categories, not numbers
    ours = LinearRegression(regParam=0.1).fit(joined.with_vectors(indexed, CELLS, "linear", counts))
    theirs = LinearRegression(regParam=0.1).fit(features.fit_features(facts, CELLS, "linear").transform(facts))
    assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray())


def test_many_labels_stay_distributed(spark):
    spec = CountSpec(("key",), "n", None)
    wide = spark.range(300_000).select(F.concat(F.lit("label "), (F.col("id") % 200_000).cast("string")).alias("key"))
    index = joined.category_index(wide, spec)
    assert index.agg(F.count("*"), F.max("index")).first() == (200_000, 199_999.0)
    indexed = joined.with_category_index(wide, spec, index)
    vectors = joined.with_vectors(indexed, spec, "linear", {"key": 200_000})
    assert vectors.first().features.size == 200_000 and "Python" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert indexed.where("key_idx >= 200000").isEmpty()
