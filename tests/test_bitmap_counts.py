"""Exact distinct counts from bitmaps, and what they save."""

from __future__ import annotations

from pyspark.sql import functions as F

from countcast.operators.profile import bitmap_distinct_counts

LINES = "/root/testdata/sf0.1/lineitem.parquet"


def shuffled(df) -> int:
    """Bytes that the exchanges of a plan wrote."""
    def written(node):
        metrics = node.metrics()
        own = metrics.apply("shuffleBytesWritten").value() if metrics.contains("shuffleBytesWritten") else 0
        children = node.children()
        return own + sum(written(children.apply(i)) for i in range(children.size()))

    df.collect()
    return written(df._jdf.queryExecution().executedPlan())


def test_odd_numbers_and_groups(spark):
    numbers = [0, 0, 1, 32_766, 32_767, 32_768, 32_769, 65_535, 65_536, 10**12, -1, None]
    df = spark.createDataFrame([(n, "g" if i % 2 else None) for i, n in enumerate(numbers)], "n bigint, g string")
    twice = df.unionByName(df).repartition(5)
    assert [tuple(r) for r in bitmap_distinct_counts(twice, {"n": "n"}).collect()] == [("n", 9)]
    by_group = {(r.g, r.dimension): r.distinct_values for r in bitmap_distinct_counts(twice, {"n": "n", "m": F.col("n") % 2}, ["g"]).collect()}
    counts = twice.where("n >= 0").groupBy("g").agg(F.countDistinct("n").alias("n"), F.countDistinct(F.col("n") % 2).alias("m"))
    assert by_group == {(r.g, d): r[d] for r in counts.collect() for d in ("n", "m")}
    assert bitmap_distinct_counts(df.limit(0), {"n": "n"}).collect() == []


def test_bitmaps_shuffle_ten_times_less_than_keys(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # metrics of a plan that does not change
    try:
        lines = spark.read.parquet(LINES)
        bitmaps = bitmap_distinct_counts(lines, {"l_orderkey": "l_orderkey"})
        keys = lines.select(F.lit("l_orderkey").alias("dimension"), F.col("l_orderkey").cast("string").alias("value")).distinct().groupBy("dimension").count()
        assert shuffled(bitmaps) * 10 <= shuffled(keys)
        assert bitmaps.first().distinct_values == keys.first()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
