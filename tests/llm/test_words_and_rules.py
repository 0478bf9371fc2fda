"""Words, quality rules and the quality classifier against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from countcast.llm import quality_classifier, quality_rules
from countcast.llm.words import text_slices
from tests.llm.conftest import SMALL, prose

_WORD = re.compile("[^\x20\x09-\x0d]+")
_TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t #! 日", max_size=60)), max_size=6)


def counted(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(_TEXTS)
def test_counts_equal_plain_python(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    found = []
    for _, w in text_slices(batch, "text"):
        columns = (w.counts, quality_rules.word_chars(w), quality_rules.n_symbols(w), quality_rules.n_dup_lines(w), quality_rules.n_repeat_words(w))
        found += list(zip(*(c.tolist() for c in columns)))
    assert found == [counted(t or "") for t in texts]


def test_cascade_keeps_what_every_rule_keeps():
    texts = [prose(i, 40 + 10 * i) for i in range(8)] + ["A! B! " * 60, prose(3, 100).upper(), "# | " * 90, "", "short text"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for _, w in text_slices(batch, "text"):
        each = np.array([~r.rejects(w) for r in quality_rules.RULES]).all(axis=0)
        for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
            assert (quality_rules.kept_texts(w, order) == each).all()
        assert each.any() and not each.all()


def test_plan_puts_rules_that_reject_nothing_last(spark):
    never = quality_rules.Rule("never", lambda w: np.zeros(w.texts, bool))
    docs = spark.createDataFrame([(prose(i, 60) if i % 2 else "a b",) for i in range(40)], "text string")
    order = quality_rules.plan(docs, [never, quality_rules.BASE[0]])
    assert [r.name for r in order] == ["few_words", "never"]


def test_odd_rows(odd, empty):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 5, 12]
    judged = quality_rules.judge(odd).collect()
    assert len(judged) == odd.count()
    assert {r.n_words for r in judged if r.doc_id in (2, 3, 8)} == {0}
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_classifier_tells_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(docs, labels).join(labels.drop("toxic"), "doc_id").where("held_out and quality is not null").toPandas()
    one, zero = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (one.predicted == 1).mean() > 0.97 and (zero.predicted == 0).mean() > 0.8


def test_classifier_on_odd_rows(spark, odd, empty):
    some = [(1, 1), (5, 1), (6, 0), (7, 0), (3, None), (None, 1)]
    labels = spark.createDataFrame(some, "doc_id bigint, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality_classifier.classify(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_density_is_that_of_the_shrunk_covariances(spark):
    rng = np.random.default_rng(2)
    d = len(quality_classifier.STATISTICS)
    rows = [(int(k % 2), *map(float, rng.normal(k % 2, 1 + k % 2, d))) for k in range(200)]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{s} double" for s in quality_classifier.STATISTICS))
    model = quality_classifier.fit(df, pooled=0.0, identity=0.0)
    data = np.array([r[1:] for r in rows])
    logs = []
    for k in (0, 1):
        own = data[k::2]
        covariance = np.cov(own.T) + 1e-6 * np.eye(d)
        centred = data - own.mean(axis=0)
        maha = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(covariance), centred)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * maha)
    got = np.array([[r.a, r.b] for r in df.select(model.log_density(0).alias("a"), model.log_density(1).alias("b")).collect()])
    assert np.allclose(got[:, 1] - got[:, 0], logs[1] - logs[0], rtol=1e-3, atol=1e-2)
    assert SMALL
