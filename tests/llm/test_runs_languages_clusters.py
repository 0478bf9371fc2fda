"""Language identification, periodic runs and clusters against brute force and planted cases."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countcast.llm import language_id, periodic_runs, va_file
from countcast.llm.queries import QUERIES
from countcast.llm.recompression import Grammar
from tests.llm.conftest import SMALL, prose

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


# Periodic runs ------------------------------------------------------------------------


def runs_by_force(words: list) -> list[tuple[int, int, int]]:
    n, smallest = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                smallest.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


_TEXTS = st.lists(
    st.tuples(st.integers(1, 3), st.lists(st.integers(0, 3), max_size=12), st.integers(1, 6), st.lists(st.integers(0, 3), max_size=9)).map(
        lambda t: t[3] + t[1] * t[2] * t[0] + t[3][:2]
    ),
    max_size=5,
)


@settings(max_examples=300, deadline=None)
@given(_TEXTS)
def test_runs_of_several_texts_equal_brute_force(texts):
    found = periodic_runs.find_runs([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in rows.tolist()] for rows in found] == [runs_by_force(t) for t in texts]


def test_candidates_of_long_texts_are_made_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SHARED_GRID", 8)
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 5)
    periodic_runs._shared_grid.cache_clear()
    pick = random.Random(4)
    for _ in range(60):
        text = [pick.randrange(3) for _ in range(pick.randrange(90))]
        assert [tuple(r) for r in periodic_runs.find_runs([np.array(text, np.int64)])[0].tolist()] == runs_by_force(text)
    monkeypatch.undo()
    periodic_runs._shared_grid.cache_clear()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=60), st.data())
def test_extensions_equal_plain_comparison(symbols, data):
    whole = np.array([8, *symbols, 9], np.int64)
    i = data.draw(st.lists(st.integers(1, len(symbols)), min_size=1, max_size=20))
    pairs = [(a, b) for a in i for b in i if a != b]
    if not pairs:
        return
    a, b = np.array(pairs).T
    for step in (1, -1):
        expected = []
        for x, y in pairs:
            n = 0
            while whole[x] == whole[y]:
                x, y, n = x + step, y + step, n + 1
            expected.append(n)
        assert Grammar(whole).extensions(a, b, step).tolist() == expected


def test_one_long_run_and_many_periods():
    words = np.array([5] * 10 + [1, 2, 3, 4, 5, 6, 7] * 20_000 + [9], np.int64)
    found = [tuple(r) for r in periodic_runs.find_runs([words])[0].tolist()]
    assert found == [(0, 10, 1), (10, 140_000, 7)]


def summary_by_force(key, text):
    words = periodic_runs.with_planted_run(key, (text or "").encode().split())
    runs = runs_by_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *numbers, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_planted_run_follows_its_formula():
    words = [str(i).encode() for i in range(57)]
    planted = 0
    for key in range(200):
        h = crc32(str(key).encode())
        g, n = h // 10, 57
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        expected = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)] if h % 10 == 0 else words
        assert periodic_runs.with_planted_run(key, list(words)) == expected
        planted += h % 10 == 0
    assert planted and periodic_runs.with_planted_run(3, []) == [] and periodic_runs.with_planted_run(None, words) is words


def test_run_summaries_of_odd_tables(odd, empty):
    short = odd.where("doc_id is null or doc_id <> 5")
    got = sorted(map(tuple, periodic_runs.summaries(short, edit=periodic_runs.with_planted_run).collect()), key=repr)
    assert got == sorted((summary_by_force(r.doc_id, r.text) for r in short.collect()), key=repr)
    assert periodic_runs.summaries(odd).count() == odd.count()
    assert periodic_runs.summaries(empty).count() == periodic_runs.scan(empty).count() == periodic_runs.collapse(empty).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b\tc x y x y x y x y\nend"), (2, "no run here"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in periodic_runs.scan(docs).collect()] == [(1, 3, 8, 2)]
    assert {r.doc_id: r.text for r in periodic_runs.collapse(docs).collect()} == {1: "a b c x y end", 2: "no run here", 3: ""}


# Language identification --------------------------------------------------------------


def toy() -> tuple[language_id.Lattice, np.ndarray, list[str]]:
    pieces = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "▁", "a", "b", "c", "ab", "▁a", "bab", "aab"]
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 3).T)
    pick = random.Random(5)
    return language_id.Lattice(pieces), logs, ["".join(pick.choice("abcé日x") for _ in range(pick.randint(1, 8))) for _ in range(80)]


def segmentations(lat: language_id.Lattice, text: str):
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        if text[:n] in lat.automaton:
            yield from ([lat.automaton.get(text[:n]), *rest] for rest in segmentations(lat, text[n:]))
    if text[0] not in lat.single:
        yield from ([*lat.bytes_at[list(text[0].encode())], *rest] for rest in segmentations(lat, text[1:]))


def likelihood(lat, logs, word):
    return np.log(sum(np.exp(sum(logs[i] for i in s)) for s in segmentations(lat, language_id.MARK + word)))


def test_forward_pass_sums_all_segmentations(monkeypatch):
    lat, logs, words = toy()
    expected = np.array([likelihood(lat, logs, w) for w in words])
    assert np.allclose(language_id.forward(lat, logs, words), expected)
    monkeypatch.setattr(language_id, "AT_ONCE", 12)  # most words are now too long to be held whole
    assert np.allclose(language_id.forward(lat, logs, words), expected)
    for part in (1, 2, 5):
        assert np.allclose([language_id._long_word(lat, logs, w, part) for w in words], expected)


def test_expected_pieces_equal_brute_force():
    lat, logs, words = toy()
    times = np.arange(1, len(words) + 1)
    expected = np.zeros(lat.size)
    for w, t in zip(words, times):
        for s in segmentations(lat, language_id.MARK + w):
            share = np.exp(sum(logs[i, 1] for i in s) - likelihood(lat, logs, w)[1])
            np.add.at(expected, s, t * share)
    assert np.allclose(language_id.expected_pieces(lat, logs[:, 1], words, times), expected)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_other_columns_teach_nothing(spark, documents):
    plain = {r.doc_id: r for r in language_id.classify(documents, VOCABULARY).collect()}
    hidden = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = documents.withColumn("lang", F.when(hidden, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).repartition(7)
    changed = {r.doc_id: r for r in language_id.classify(other, VOCABULARY).collect()}
    assert {k: (r.held_out, r.lang_pred, round(r.score, 6)) for k, r in plain.items()} == {k: (r.held_out, r.lang_pred, round(r.score, 6)) for k, r in changed.items()}


def test_languages_of_odd_tables(spark, odd, empty):
    rows = language_id.classify(odd, VOCABULARY).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {None, 2, 3, 8}
    assert all(r.score == 0 if r.lang_pred == "und" else r.lang_pred in ("en", "fr") for r in rows)
    assert [r.lang_pred for r in rows].count("und") == 4
    assert language_id.classify(empty, VOCABULARY).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.classify(unlabelled, VOCABULARY).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 !", "en"), (2, "abc def", "en")], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.classify(digits.union(digits), VOCABULARY, withheld=F.lit(False)).collect()} == {1: "und", 2: "en"}


# Clusters -----------------------------------------------------------------------------


def clusters_by_force(rows, k, rounds, salt, scale=256.0, dims=64):
    kept = [(key, v) for key, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept = [(key, np.clip(np.floor(scale * np.array(v, np.float64)), -va_file.LARGEST, va_file.LARGEST).astype(np.int64)) for key, v in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [v for _, v in first[:k]]
    vectors = np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        distance = ((vectors[:, None] - np.array(centroids)[None]) ** 2).sum(axis=2)
        own = distance.argmin(axis=1)
        if turn < rounds:
            centroids = [np.array([int(s) // int((own == c).sum()) for s in vectors[own == c].sum(axis=0)]) if (own == c).any() else centroids[c] for c in range(len(centroids))]
    distance = distance.min(axis=1)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(((key, int(c), int(d), int(distance[own == c].sum()), int(distance.sum()), digests[c]) for (key, _), c, d in zip(kept, own, distance)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("cluster", F.lit("c")).withColumn("key", F.lit(1))


def crowd(seed: int, n: int) -> list[tuple]:
    """Vectors around a few centres, a third of them equal, with all that may be left out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (5, 64))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 5] + rng.normal(0, 0.05 + 0.1 * (i % 2), 64)).astype(np.float32).tolist(), 0) for i in range(n)]
    odd = [(None, rows[1][1], 0), (n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 63, 0), (n + 3, [0.0] * 63 + [None], 0), (n + 4, [float("nan")] + [0.0] * 63, 0)]
    return rows + odd + [(n + 5, [float("inf")] + [0.0] * 63, 0), (n + 6, [1e30, -1e30] + [0.0] * 62, 0), rows[4], rows[4], (rows[4][0], rows[5][1], 0)]


@pytest.mark.parametrize("n, k, bits, parts", [(400, 7, 8, 3), (150, 40, 3, 1), (6, 40, 8, 2), (90, 1, 1, 5)])
def test_clusters_equal_brute_force(spark, n, k, bits, parts):
    rows = crowd(n, n)
    found = va_file.cluster(vectors(spark, rows).repartition(parts), k, 4, "vec_id", "embedding", 64, 256.0, "7:", bits)
    expected = clusters_by_force([r[:2] for r in rows], k, 4, "7:")
    assert sorted(((r.key, r.cluster, r.distance) for r in found.members().collect()), key=repr) == [e[:3] for e in expected]
    digests = {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()}
    assert {e[5] for e in expected} <= digests


def test_cluster_summaries_equal_brute_force(spark):
    rows = crowd(1, 300)
    got = sorted(map(tuple, va_file.summary(vectors(spark, rows)).collect()), key=repr)
    assert got == clusters_by_force([r[:2] for r in rows], 40, 5, "2:")
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert va_file.summary(table.limit(0)).count() == 0 and va_file.summary(table.where("false")).dtypes == va_file.summary(table).dtypes


def test_bounds_hold_every_distance_and_few_vectors_are_fetched(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 64)).tolist(), 0) for i in range(600)]
    found = va_file.cluster(vectors(spark, rows), 6, 3, "vec_id", "embedding", 64, 256.0, "2:", 4)
    assert found.fetched[-1] < 120  # the centres are far apart: most vectors are not read
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    bounds = va_file.intervals(va_file._cells(v, found.va.borders), va_file.bound_tables(found.va.borders, found.centroids))
    exact = ((v[:, None] - found.centroids[None]) ** 2).sum(axis=2)
    assert (bounds[:, :6] <= exact).all() and (exact <= bounds[:, 6:]).all()


def test_near_vectors_are_read_together(tmp_path, monkeypatch):
    v = np.arange(5000 * 4, dtype="<i4").reshape(5000, 4)
    (tmp_path / "v").write_bytes(v.tobytes())
    reads = []

    class Counting:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def read(self, n):
            reads.append(n)
            return self.file.read(n)

    monkeypatch.setattr(va_file, "GAP", 160)
    rows = np.array([0, 3, 9, 200, 201, 4999])
    with open(tmp_path / "v", "rb") as file:
        assert (va_file.fetch(Counting(file), rows, 4) == v[rows]).all()
    assert reads == [160, 32, 16]
