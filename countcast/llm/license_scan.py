"""License scans: a trained paragraph classifier, confirmed by templates. JVM only.

Paragraphs are the lines of a text. Their words (letters and digits, lower case) and word pairs,
as far as the templates have them too, are the terms on which a multinomial logistic regression
tells licence families from each other and from ordinary text, the class ``unknown``. It is trained
on the templates of the families, whole and in cut pieces, and on all the table's paragraphs that
hold no template's rare word: those of equal terms are one weighted row. The documents are dealt in
two halves by their row keys, one to learn from and one by which the least probability of a
family is calibrated, so that at most ``FALSE_RATE`` of its paragraphs would pass as any family. A
prediction counts when the family's template confirms it: enough of the template's word pairs
are in the paragraph. Paragraphs that no template can confirm need no prediction.

Everything is DataFrame functions and Spark ML stages: no Python runs on the executors.

Defined results: null and empty texts have no paragraphs, paragraphs without words are none;
repeated rows and paragraphs are reported each (by row key and line number); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.llm.rows import with_row_ids
from countcast.workspace import stored

#: Families and the notices by which their licences ask to be announced.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
}
UNKNOWN = "unknown"
#: Weight of a cut notice, and of all ordinary paragraphs together, in training.
NOTICE, ORDINARY = 5.0, 5000.0
#: Share of ordinary paragraphs that may pass the classifier (templates confirm after it).
FALSE_RATE = 0.001
#: Probabilities are told apart by one in so many when the least one is chosen.
EDGES = 10_000
#: Share of a template's word pairs that a paragraph must hold.
CONFIRMED = 0.75
#: Words in one scored piece of a longer paragraph, and between their beginnings; pieces overlap
#: by more words than a notice has.
PIECE, STRIDE = 96, 64


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def pairs(w: Column) -> Column:
    """Neighbouring words as one string each."""
    n = F.size(w)
    return F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, words) of every line that has words."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "paragraph"))
    some = lines.where(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))  # else there are no words; a test of those would split twice
    return some.select("row", "doc_id", "line", words(F.col("paragraph")).alias("words"))


def pieces(found: DataFrame) -> DataFrame:
    """The paragraphs in overlapping pieces: a notice within a long line is not drowned."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (PIECE - STRIDE)), F.lit(STRIDE))
    return found.select("row", "doc_id", "line", "words", F.explode(starts).alias("start")).select(
        "row", "doc_id", "line", F.slice("words", F.col("start"), PIECE).alias("words")
    )


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(family, template, words) of the notices."""
    rows = [(family, f"{family}#{i}", notice) for family, notices in templates.items() for i, notice in enumerate(notices)]
    return spark.createDataFrame(rows, "family string, template string, notice string").select("family", "template", words(F.col("notice")).alias("words"))


def _with_terms(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """With the column ``terms``: the words and pairs that the vocabulary has, each once, sorted."""
    terms = F.array_intersect(F.concat("words", pairs(F.col("words"))), F.array(*map(F.lit, vocabulary)))
    return rows.withColumn("terms", F.array_sort(terms))


def _examples(table: DataFrame) -> DataFrame:
    """(label family, words): each notice whole, without its ends, and amid other words."""
    cut = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(4))))
    some = table.select("family", "words", cut.alias("cut"))
    n = F.size("words") - F.col("cut.a") - F.col("cut.b")
    return some.where(n > 3).select("family", F.slice("words", F.col("cut.a") + 1, n).alias("words"))


def train(found: DataFrame, table: DataFrame) -> tuple[PipelineModel, list[str], list[str], float]:
    """(model, its vocabulary, families in the order of its classes, least probability) from the
    notices and all the paragraphs ``found``."""
    families = sorted({r["family"] for r in table.select("family").collect()})
    vocabulary = sorted({t for r in table.select(F.concat("words", pairs(F.col("words"))).alias("terms")).collect() for t in r["terms"]})
    common = ["under", "the", "this", "work", "is", "a", "in", "and", "or", "of", "to", "it", "you", "not", "use", "may", "are", "that", "by", "as", "any", "can", "file", "v", "2", "0", "3", "4", "with", "for", "free", "terms", "form", "code", "source"]
    rare = [t for t in vocabulary if " " not in t and t not in common]
    plain = found.where(~F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    half = (F.pmod(F.xxhash64("row"), F.lit(2)) == 0).alias("fit")
    some = stored(_with_terms(plain, vocabulary).groupBy("terms", half).agg(F.count("*").alias("n")), "paragraphs")
    total = {r["fit"]: r["n"] for r in some.groupBy("fit").agg(F.sum("n").alias("n")).collect()}
    ordinary = some.where("fit").select(F.lit(UNKNOWN).alias("family"), "terms", (F.col("n") * F.lit(ORDINARY / total.get(True, 1))).alias("weight"))
    rows = _with_terms(_examples(table), vocabulary).select("family", "terms", F.lit(NOTICE).alias("weight")).unionByName(ordinary)
    classes = [UNKNOWN, *families]
    index = F.element_at(F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i))))), F.col("family"))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features", minTF=1.0).setBinary(True)
    stages = [
        counts,
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=0.003, maxIter=60),
    ]
    model = Pipeline(stages=stages).fit(rows.withColumn("label", index).where("label is not null"))
    edge = F.ceil(F.col("p") * EDGES)
    above = _scored(model, some.where("not fit")).where("p >= 0.5").groupBy(edge.alias("edge")).agg(F.sum("n").alias("n"))
    allowed, least = FALSE_RATE * total.get(False, 0), 0.5
    for r in above.orderBy(F.desc("edge")).collect():  # at most EDGES rows
        allowed -= r["n"]
        if allowed < 0:
            least = (r["edge"] + 1) / EDGES
            break
    return model, vocabulary, classes, least


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """With the likeliest family (its class) and its probability ``p``."""
    known = F.slice(F.col("ps"), 2, F.size("ps") - 1)
    out = model.transform(rows).withColumn("ps", vector_to_array("probability"))
    return out.withColumn("p", F.array_max(known)).withColumn("class", F.array_position(known, F.col("p")).cast("int")).drop("features", "rawPrediction", "probability", "prediction", "ps")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(doc_id, line, family, probability, similarity) of the lines that announce a licence."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    docs = with_row_ids(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "row")
    found = pieces(paragraphs(docs))
    model, vocabulary, classes, least = train(found, table)
    names = F.array(*map(F.lit, classes))
    notices = [set(r["pairs"]) for r in table.select(pairs(F.col("words")).alias("pairs")).collect()]
    fewest = min(ceil(CONFIRMED * len(n)) for n in notices)
    some_pairs = F.array_intersect(pairs(F.col("words")), F.array(*map(F.lit, sorted(set().union(*notices)))))
    likely = stored(found.where(F.size(some_pairs) >= fewest), "likely")
    passed = _scored(model, _with_terms(likely, vocabulary)).where(F.col("p") >= least).withColumn("family", F.element_at(names, F.col("class") + 1))
    own = pairs(F.col("words"))
    similarity = F.lit(0.0)
    for r in table.select("family", pairs(F.col("words")).alias("pairs")).collect():
        wanted = F.array(*map(F.lit, dict.fromkeys(r["pairs"])))
        share = F.size(F.array_intersect(own, wanted)) / F.size(wanted)
        similarity = F.greatest(similarity, F.when(F.col("family") == r["family"], share).otherwise(0.0))
    checked = passed.withColumn("similarity", similarity).where(F.col("similarity") >= CONFIRMED)
    best = F.max_by(F.struct("family", F.col("p").alias("probability"), "similarity"), F.struct("similarity", "p", "family")).alias("best")
    return checked.groupBy("row", "doc_id", "line").agg(best).select("doc_id", "line", "best.*")
