"""Tables whose rows or columns are easily confused: exploded, united, oddly named, long words."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countcast.llm import decontaminate, jaccard_join, quality_rules, secret_scan, sentence_pieces, warc
from countcast.llm.rows import with_row_ids
from tests.llm.conftest import SMALL, prose

ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
TWO = ONE.translate(str.maketrans("ab", "ba"))  # the same value under any polynomial modulo 2 ** 64


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, prose(k % 9, 90), "en", "s") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({"_metadata": F.lit("m"), "a.b": F.lit("dot"), "IDS": F.lit("upper")})


def test_every_row_has_a_key_of_its_own(spark, documents, awkward):
    twice = documents.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for table in (documents, twice, documents.union(documents), documents.where("doc_id > 5").select("text"), awkward):
        keyed = with_row_ids(table, "key")
        assert keyed.agg(F.countDistinct("key")).first()[0] == table.count()
        again = {r.key for r in keyed.select("key").collect()}
        assert again == {r.key for r in keyed.select("key").collect()}


def test_exploded_tables_keep_their_rows(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(10)
    path = f"{SMALL}/pages.parquet"
    twice = spark.read.parquet(path).where(F.col("page_id").isin([r.page_id for r in pages.collect()])).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    assert warc.archive_index(spark, twice).count() == 20
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    assert jaccard_join.join(docs).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark, awkward):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for stage in (quality_rules.keep_good, jaccard_join.keep_one, lambda d: decontaminate.keep_clean(d, benchmark), secret_scan.redact):
        found = stage(awkward)
        assert found.columns == awkward.columns and 0 < found.count() <= 12
        assert {tuple(r)[-3:] for r in found.collect()} == {("m", "dot", "upper")}
    encoded = sentence_pieces.encode(awkward, public_tokenizers.path("piece_bpe_32k.model"))
    assert encoded.columns == [*awkward.columns[:-1], "ids"] and encoded.where("size(ids) > 0").count() == 12


def test_the_pipeline_takes_awkward_and_odd_and_empty_tables(spark, awkward, odd):
    for docs, least in ((awkward, 1), (odd, 1), (awkward.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and docs.count() >= least


def test_long_words_with_equal_polynomials_are_told_apart(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE}\n{TWO}"), (4, f"{ONE}\n{ONE}")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.judge(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_crowds_around_a_text_and_crowds_of_strangers(spark, monkeypatch):
    """Many near copies of one text, and many texts that share its first half and no more."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    base = prose(77, 120).split()
    rows = [(k, " ".join([*base[: 60 + k % 5], f"w{k}", *base[61 + k % 5 :]])) for k in range(150)]
    rows += [(1000 + k, " ".join([*base[:60], *prose(2000 + k, 60).split()])) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert all(got[k] == 0 for k in range(150)) and all(got[1000 + k] == 1000 + k for k in range(150))
