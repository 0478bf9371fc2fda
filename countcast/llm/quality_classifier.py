"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Every text gives a dozen statistics, transformed so that their classes look more like normal
distributions. The fit is one aggregation over the labelled rows: counts, sums and cross
products of each class, so the driver gets two rows of fixed size. Each class covariance is
shrunk towards the pooled one and towards its own diagonal mean; its Cholesky factor is
computed once and kept in the model. The score is the posterior of class 1 from the difference of
the Mahalanobis log-densities, a JVM expression over the statistics; as such densities are far
too sure of themselves, a logistic line through the (asinh of the) differences of the labelled
rows calibrates it.

Defined results: a null text is an empty one; empty texts have a score like any other; a null
label is none; several labels of one document count as the largest; with one class or no
labels, all scores are the share of class 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.llm import quality_rules as rules
from countcast.llm.words import Words, text_slices
from countcast.workspace import stored

STATISTICS = (
    "log_words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "exclaimed",
    "punctuation", "log_line_words", "foreign_bytes", "distinct_words",
)
#: Shares of the pooled covariance, and of the identity times the mean variance, in a class's.
POOLED, IDENTITY = 0.1, 0.02
#: Labelled rows of one class needed for a covariance of its own.
LEAST_ROWS = 2 * len(STATISTICS)

_DIGIT = rules._lookup("0123456789")
_PUNCT = rules._lookup("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))


def statistics(w: Words) -> list[np.ndarray]:
    """The transformed statistics of each text: logs of counts, square roots of shares."""
    n = np.maximum(w.counts, 1)
    size = np.maximum(np.diff(w.edges), 1)
    letters = np.maximum(w.sums(rules._LETTER[w.data]), 1)
    lines, again = rules.line_counts(w)
    lines = np.maximum(lines, 1)
    keys = np.unique(rules.mixed(w.hashes + w.text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w.text_of[keys], minlength=w.texts)
    return [
        np.log1p(w.counts),
        np.log1p(rules.word_chars(w) / n),
        np.sqrt(rules.n_symbols(w) / n),
        np.sqrt(again / lines),
        np.sqrt(rules.n_repeat_words(w) / n),
        np.sqrt(w.sums(rules._UPPER[w.data]) / letters),
        np.sqrt(w.sums(_DIGIT[w.data]) / size),
        np.sqrt(w.sums(w.data == 33) / n),
        np.sqrt(w.sums(_PUNCT[w.data]) / size),
        np.log1p(w.counts / lines),
        np.sqrt(w.sums(w.data >= 128) / size),
        np.sqrt(distinct / n),
    ]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                columns = [pa.array(c, pa.float64()) for c in statistics(w)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *STATISTICS])

    schema = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, and the inverse of the Cholesky factor of its covariance."""

    prior: float  # share of class 1
    classes: tuple[tuple[float, np.ndarray, np.ndarray], ...]
    slope: float = 1.0
    offset: float = 0.0

    def log_density(self, k: int) -> Column:
        """Up to a constant that all classes share."""
        log_prior, mean, inverse = self.classes[k]
        centred = [F.col(s) - F.lit(float(m)) for s, m in zip(STATISTICS, mean)]
        total = F.lit(float(log_prior + np.log(np.diag(inverse)).sum()))
        for row in range(len(STATISTICS)):
            z = F.lit(0.0)
            for j in range(row + 1):
                z = z + F.lit(float(inverse[row, j])) * centred[j]
            total = total - F.lit(0.5) * z * z
        return total

    def difference(self) -> Column:
        """How much likelier class 1 is, as a log, drawn together by asinh."""
        return F.asinh(self.log_density(1) - self.log_density(0))

    def score(self) -> Column:
        if not self.classes:
            return F.lit(self.prior)
        return 1 / (1 + F.exp(-(self.slope * self.difference() + self.offset)))

    def calibrated(self, labelled: DataFrame, label: str = "label") -> Discriminant:
        """The model with the line that a slightly regularised logistic regression finds."""
        if not self.classes:
            return self
        rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), self.difference().alias("x"))
        line = LogisticRegression(regParam=1e-4, standardization=True, maxIter=50).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
        return replace(self, slope=float(line.coefficients[0]), offset=float(line.intercept))


def fit(labelled: DataFrame, label: str = "label", pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """From rows of statistics with a label of 0 or 1."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count("*").alias("n"),
        *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)),
        *(F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs),
    )
    rows = {r[label]: r for r in sums.collect()}  # two rows at most
    total = sum(r["n"] for r in rows.values())
    prior = rows[1]["n"] / total if 1 in rows else (0.0 if total else 0.5)
    if len(rows) < 2:
        return Discriminant(prior, ())
    means, scatter = {}, {}
    for k, r in rows.items():
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        means[k], scatter[k] = mean, products - r["n"] * np.outer(mean, mean)
    common = (scatter[0] + scatter[1]) / max(1, total - 2)
    floor = np.diag(np.maximum(1e-9, 1e-6 * np.abs(np.diag(common)).max()) * np.ones(d))
    scale = np.sqrt(np.diag(common) + np.diag(floor))  # shrinking to the identity needs one scale
    classes = []
    for k in (0, 1):
        n = rows[k]["n"]
        own = scatter[k] / max(1, n - 1)
        share = pooled if n >= LEAST_ROWS else 1.0
        mix = ((1 - share) * own + share * common + floor) / np.outer(scale, scale)
        mix = (1 - identity) * mix + identity * np.trace(mix) / d * np.eye(d)
        factor = np.linalg.cholesky(mix)
        inverse = np.linalg.inv(factor) / scale
        classes.append((float(np.log(n / total)), means[k], np.tril(inverse)))
    return Discriminant(prior, tuple(classes))


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that no fit sees: crc32 of the key's text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = stored(with_statistics(docs), "statistics")
    known = labels.select("doc_id", F.col(label).alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    training = stored(rows.where(~held_out(F.col("doc_id"))).join(known, "doc_id"), "labelled")
    model = fit(training).calibrated(training)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
