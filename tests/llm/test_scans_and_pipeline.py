"""Secrets, licences, the pipeline and the registered queries."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from countcast.llm import license_scan, queries, secret_scan
from tests.llm.conftest import SMALL, prose


def test_secrets_are_found_and_other_long_words_are_not(spark, odd, empty):
    secret, other = "9f8a7d6c5b4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a", "aZ3kQ9xW7mB2vN8cL5tR1yU6pO4iE0sD"
    rows = [
        (1, f'{prose(1, 40)} token = "{secret}" {prose(2, 20)}', "a"), (2, f"api_key: '{other}'", "b"), (3, f"see https://example.org/x/{secret} here", "a"),
        (4, f"{prose(3, 60)} internationalisation constitutionally-yours", "c"), (5, "card 4111111111111111 of 2020", "d"), (6, f"é {secret[:20]} and token = \"{secret}\"", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: (r.start, r.length) for r in secret_scan.scan(docs).collect() if r.doc_id != 6}
    texts = {k: t for k, t, _ in rows}
    assert set(found) == {1, 2} and texts[1][found[1][0] :][: found[1][1]] == secret
    hidden = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert secret not in hidden[1] + hidden[6].split("token")[1] and hidden[4] == texts[4] and hidden[3] == texts[3]
    changed = secret_scan.redact(odd)
    assert changed.columns == odd.columns and sorted(map(str, changed.collect())) == sorted(map(str, odd.collect()))
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redact(empty).count() == 0


def test_secrets_of_the_tables(spark, documents):
    want = {(r.doc_id, m.start(1)) for r in documents.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    assert {(r.doc_id, r.start) for r in secret_scan.scan(documents).collect()} == want


def test_short_and_broken_secrets_under_key_words(spark, documents):
    secrets = [
        ('password = "{}"', "Tr0ub4dor8"), ("db_password: {}", "Xk9!vQ2@rT7#mZ4$"), ("DB_PASSWD={};", "hG7$kw2"), ("secret => '{}'", "q8R&zz!Lp0 x"),
        ('{{"api_key": "{}"}}', "b7Tq9ZpL2m"), ("Authorization: Bearer {}", "zQ4.mN8~pT1.kL6"),
    ]
    plain = ["password: required", "key = 42", 'token = ""', "secret = ${vault_name}", 'the key "value" of it', "auth: true", "monkey: the public name"]
    rows = [(50_000 + k, f"{prose(k, 30)}\n{form.format(value)}\n{prose(k, 20)}") for k, (form, value) in enumerate(secrets)]
    rows += [(60_000 + k, f"{prose(k, 30)}\n{text}\n{prose(k, 20)}") for k, text in enumerate(plain)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    texts = dict(rows)
    got = {(r.doc_id, texts[r.doc_id][r.start : r.start + r.length]) for r in secret_scan.scan(docs).where("doc_id >= 50000").collect()}
    assert got == {(50_000 + k, value) for k, (_, value) in enumerate(secrets)}
    hidden = {r.doc_id: r.text for r in secret_scan.redact(docs).where("doc_id >= 50000").collect()}
    assert all(hidden[50_000 + k] == texts[50_000 + k].replace(value, secret_scan.MASK) for k, (_, value) in enumerate(secrets))


def test_dictionary_does_not_depend_on_the_layout(spark, documents, monkeypatch):
    texts = documents.select("text")
    want = Counter(v for r in texts.collect() for x in re.findall(r"[^\x20\x09-\x0d]+", r.text or "") for v in [_plain(x)] if v)
    total = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in texts.collect())
    frequent = {w for w, n in want.items() if n >= max(3, total / secret_scan.DICTIONARY)}
    assert secret_scan.corpus_tables(texts.repartition(97)).dictionary == frequent == secret_scan.corpus_tables(texts.coalesce(1)).dictionary
    monkeypatch.setattr(secret_scan, "FORMS", 50)
    assert secret_scan.corpus_tables(texts.repartition(3)).dictionary == frequent


def _plain(word: str) -> bytes | None:
    """The dictionary form of a word, if it has one."""
    raw = word.encode()
    plain = raw.lower().strip(b".,;:!?")
    return plain if 3 <= len(raw) < secret_scan.SHORTEST and plain.isalpha() else None


def test_licences_of_families_are_found(spark, documents, odd, empty):
    notices = [(k, t) for k, ts in license_scan.TEMPLATES.items() for t in ts]
    rows = [(i, f"{prose(i, 40)}\n{notice.upper()}!\n{prose(i + 50, 40)}") for i, (_, notice) in enumerate(notices)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in rows], "doc_id bigint, text string"))
    got = {(r.doc_id, r.family) for r in license_scan.scan(docs).collect()}
    planted = {(10_000 + i, family) for i, (family, _) in enumerate(notices)}
    own = {r.doc_id for r in documents.where("text rlike '(?i)licensed under|released under'").collect()}
    assert planted <= got and {d for d, _ in got - planted} == own
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


def test_license_classifier_learns_from_every_paragraph(spark, monkeypatch):
    """3,000 documents: about one in three was looked at before."""
    seen, stored = {}, license_scan.stored
    monkeypatch.setattr(license_scan, "stored", lambda df, label: seen.setdefault(label, stored(df, label)))
    docs = spark.createDataFrame([(k, f"the words of row x{k % 50}\nand a line") for k in range(3000)], "doc_id bigint, text string")
    assert license_scan.scan(docs).count() == 0
    counted = seen["paragraphs"].groupBy("terms").agg({"n": "sum"}).collect()
    assert sum(r["sum(n)"] for r in counted) == 6000 and len(counted) == 2


def test_license_scan_runs_no_python(spark, documents):
    plan = license_scan.scan(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "sentencepiece":
            assert out.schema == docs.schema
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        docs, before, n = out, n, out.count()
        assert n <= before
    assert docs.where("n_tokens <> size(ids)").isEmpty() and n > 100
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
