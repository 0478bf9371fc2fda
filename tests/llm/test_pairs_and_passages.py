"""Similarity join, repeated passages and benchmark leaks against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from countcast.llm import decontaminate, jaccard_join, substring_dedup
from countcast.llm.components import components
from countcast.llm.words import Words, buffer_of
from tests.llm.conftest import edited, prose


def shingles(text: str) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(keys: list[int], linked) -> dict[int, int]:
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=12))
def test_block_links_connect_what_is_similar(sets):
    lists = [sorted(s) for s in sets]
    linked = [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    keys = list(range(len(sets)))
    bound = jaccard_join.HEAPED
    for jaccard_join.HEAPED in (bound, 0):  # merged by heap, and counted
        assert groups(keys, jaccard_join.block_links(lists)) == groups(keys, linked)
    jaccard_join.HEAPED = bound


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20), max_size=10), min_size=1, max_size=8), st.integers(1, 5), st.integers(0, 6))
def test_merge_skip_counts(lists, least, low):
    lists = sorted((sorted(x) for x in lists), key=len)
    want = {e: n for e in range(low, 21) if (n := sum(e in x for x in lists)) >= least}
    assert dict(jaccard_join.t_occurrence(lists, least, low, 0)) == want


def test_join_equals_brute_force(spark, documents, monkeypatch):
    base = [prose(k, 200) for k in range(6)]
    rows = [(1000 + k, edited(base[k % 6], k, 8 + 6 * (k % 7))) for k in range(120)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    texts = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    linked = [(a, b) for a, b in combinations(texts, 2) if texts[a] and 100 * len(texts[a] & texts[b]) >= 75 * len(texts[a] | texts[b])]
    want = {k: (len(texts[k]), c) for k, c in groups(list(texts), linked).items()}
    for block, long in ((512, 512), (8, 5)):  # small bounds give hubs of many blocks and lists in parts
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "LONG", long)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
        assert got == want


def test_join_of_odd_rows(odd, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.join(odd).select("doc_id", "n_shingles", "component_id").collect())
    by_key = {k: c for k, _, c in got}
    assert by_key[1] == by_key[12] == 1 and by_key[6] == by_key[7] == 6 and by_key[2] == 2 and by_key[3] == 3
    assert by_key[10] == 10 and [n for k, n, _ in got if k in (2, 3, 8)] == [0, 0, 0]
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 8, 9, 10, 11]
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_planted_passages_are_found_and_nothing_else(spark, odd, empty):
    exact, fuzzy = prose(50, 70), prose(51, 100)
    rows = [(k, prose(60 + k, 300)) for k in range(8)]
    rows += [(20 + k, f"{prose(80 + k, 150)}\n{exact}\n{prose(90 + k, 90)}") for k in range(4)]
    rows += [(30 + k, f"{prose(110 + k, 60)}\n{edited(fuzzy, k, 14)}\n{prose(120 + k, 150)}") for k in range(3)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = {k: t.split() for k, t in rows}
    assert {r.doc_id for r in got} | {r.other_doc_id for r in got} == {20, 21, 22, 23, 30, 31, 32}
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.other_doc_id][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= substring_dedup.MIN_WORDS
        assert substring_dedup.common_words(a, b) >= r.common_words >= 0.75 * max(len(a), len(b))
        if r.doc_id < 30:
            assert len(a) >= len(exact.split()) - 1
    odd_rows = substring_dedup.repeated_passages(odd).collect()
    assert {(r.doc_id, r.other_doc_id) for r in odd_rows} >= {(1, 1)} and {1, 12} <= {k for r in odd_rows for k in (r.doc_id, r.other_doc_id)}
    assert substring_dedup.repeated_passages(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=9))
def test_best_chain_has_the_best_score(points):
    points = sorted(set(points))

    def score(chain) -> float:
        gaps = sum(c - a + d - b for (a, b), (c, d) in zip(chain, chain[1:]))
        return substring_dedup.KMER * len(chain) - substring_dedup.GAP * gaps

    ascending = [c for n in range(1, len(points) + 1) for c in combinations(points, n) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:]))]
    found = substring_dedup.chains([p[0] for p in points], [p[1] for p in points])
    assert sorted(p for c in found for p in c) == points
    assert abs(score(found[0]) - max(map(score, ascending))) < 1e-9


def replaced(text: str, seed: int, share: float) -> str:
    """The text with exactly this share of its words replaced."""
    words = text.split()
    for i in np.random.default_rng(seed).choice(len(words), int(share * len(words)), replace=False):
        words[i] = f"new{i}of{seed}"
    return " ".join(words)


def test_fuzzy_passages_are_found_down_to_the_identity(spark):
    cases = [(size, share) for size in (60, 100) for share in (0.10, 0.15, 0.20, 0.25) for _ in range(12)]
    rows, meant = [], {}
    for k, (size, share) in enumerate(cases):
        passage = " ".join(prose(3000 + k, size + 20).split()[:size])
        other = replaced(passage, k, share)
        rows += [(2 * k, f"{prose(4000 + k, 60)}\n{passage}\n{prose(5000 + k, 60)}"), (2 * k + 1, f"{prose(6000 + k, 80)}\n{other}\n{prose(7000 + k, 40)}")]
        assert substring_dedup.common_words(passage.split(), other.split()) >= substring_dedup.IDENTITY * size  # by brute force
        meant[2 * k, 2 * k + 1] = share
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    recall = {share: sum(p in got for p, s in meant.items() if s == share) / 24 for share in (0.10, 0.15, 0.20, 0.25)}
    assert got <= set(meant)
    assert recall[0.10] == 1 and recall[0.15] >= 0.95 and recall[0.20] >= 0.9, recall


def test_two_common_lines_in_a_rare_order_are_a_passage(spark):
    first, second = (" ".join(prose(k, 40).split()[:30]) for k in (8001, 8002))
    rows = [(k, f"{prose(8100 + k, 60)}\n{(first, second)[k % 2]}\n{prose(8300 + k, 60)}") for k in range(100)]
    rows += [(k, f"{prose(8500 + k, 60)}\n{first}\n{second}\n{prose(8700 + k, 60)}") for k in (500, 501)]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got & {(500, 501), (501, 500)}


def test_thinned_matches_cover_the_same_words():
    pos_a, pos_b = [*range(10, 23), 40, 41, 7], [*range(30, 43), 12, 13, 90]
    some = list(zip(*substring_dedup.thinned(pos_a, pos_b)))

    def covered(points) -> set:
        return {(a + i, b + i) for a, b in points for i in range(substring_dedup.KMER)}

    assert covered(some) == covered(zip(pos_a, pos_b)) and len(some) == 7


def test_wide_gaps_part_passages():
    near, far = [(5 * k, 5 * k) for k in range(60)], [(900 + 5 * k, 700 + 5 * k) for k in range(60)]
    found = substring_dedup.chains(*zip(*(near + far)))
    assert [len(c) for c in found] == [60, 60]


def test_leaks_equal_brute_force(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    plain = lambda t: " ".join(re.findall("[^\x00-\x20!-/:-@\\[-`{-~]+", t.lower()))
    clean = {r.doc_id for r in documents.collect() if not any(plain(t) in plain(r.text or "") for t in items.values())}
    paraphrase = {5000 + k: prose(k, 60) + " " + edited(t, k, 9) + " " + prose(k + 1, 60) for k, t in items.items() if len(t.split()) > 20}
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(paraphrase.items()), "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    found = {d for d, _ in got}
    want = {r.doc_id for r in documents.collect()} - clean
    assert want <= found and not found & clean
    held = [(k, k - 5000) for k, t in paraphrase.items() if substring_dedup.common_words(plain(items[k - 5000]).split(), plain(t).split()) >= 0.8 * len(plain(items[k - 5000]).split())]
    assert len(set(held) & got) >= 0.9 * len(held) > 0  # recall of the search by cosine


def test_leaks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, prose(2, 80)), (2, None), (3, ""), (None, "one two"), (4, prose(2, 80)), (5, "word word")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()}
    assert {(None, 1), (None, 4), (6, None), (7, None), (10, 5)} <= got
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.where("doc_id is null and text is not null").count() == 0
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_bit_parallel_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 30)).tolist(), rng.integers(0, 4, rng.integers(1, 30)).tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_words(a, b) == substring_dedup.common_words(a, b) == table[-1, -1]


def test_the_space_is_fitted_on_every_document_that_may_hold_a_passage(spark):
    """4,100 documents: one in two was in the fit before. No passage is lost by the bound on words."""
    items = [prose(7000 + k, 60).replace("\n", " ").split(" ")[:30] for k in range(6)]
    held = {k: " ".join([*prose(k, 20).split(), *edited(" ".join(items[k % 6]), k, 12).split(), *prose(-k - 1, 20).split()]) for k in range(0, 4100, 20)}
    docs = spark.createDataFrame([(k, k, held.get(k, f"plain words of row {k}")) for k in range(4100)], "row bigint, doc_id bigint, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    (block,) = decontaminate.blocks(decontaminate.passages(benchmark).cache())
    assert decontaminate.with_idf(block, docs) == 4100
    near = decontaminate.possible(block, docs)
    assert {r.doc_id for r in near.collect()} == set(held)
    rows = decontaminate._fit_rows(spark, block, near.cache()).count()
    assert rows >= len(held) + len(items)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert len(found & {(k, k % 6) for k in held}) >= 0.9 * len(held)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 65), st.integers(2, 30))
def test_no_window_that_holds_a_passage_is_passed_over(seed, n, spread):
    pick = np.random.default_rng(seed)
    passage = pick.integers(0, spread, n).tolist()
    text = np.concatenate([pick.integers(0, spread + 8, pick.integers(0, 50)), [w for w in passage if pick.random() < 0.8], pick.integers(0, spread + 8, 30)]).astype(int)
    _, w = next(decontaminate.plain_slices(pa.record_batch({"text": ["x", " ".join(f"w{k}" for k in text), None]})))
    _, names = next(decontaminate.plain_slices(pa.record_batch({"text": [" ".join(f"w{k}" for k in range(spread))]})))
    vocabulary = np.sort(names.hashes)
    place = np.searchsorted(vocabulary, names.hashes)
    own = place[passage].tolist()
    block = decontaminate.Block(vocabulary, [1], [own], [own[-3:]], idf=pick.random(spread))
    found = decontaminate.windows(block, w)
    kept = {int(s) for _, some, _ in found.classes for s in some}
    of_text = np.where(text < spread, place[np.minimum(text, spread - 1)], -1)
    width = next(x for x in decontaminate.WINDOWS if n <= x - decontaminate.STEP + 1)
    first = int(found.first_step[1])
    for s in range(-(-len(text) // decontaminate.STEP)):
        window = of_text[s * decontaminate.STEP : s * decontaminate.STEP + width].tolist()
        assert first + s in kept or not decontaminate.leaked(own, own[-3:], window)[2]


def test_parts_of_a_dealt_list_stay_linked(spark, monkeypatch):
    """A passage of 200 documents whose seeds' lists are dealt in 9 parts: one group, not nine."""
    monkeypatch.setattr(substring_dedup, "LONG", 24)
    passage = prose(1, 60).replace("\n", " ")
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(200)]
    docs = spark.createDataFrame([(k, f"{w} {passage} {w}") for k, w in enumerate(own)], "doc_id bigint, text string").coalesce(1)
    seeds, parts, _ = substring_dedup.frequent(docs)
    assert len(seeds) and set(parts) == {9}
    found = [(r.doc_id, r.other_doc_id) for r in substring_dedup.repeated_passages(docs).collect()]
    assert set(groups(list(range(200)), found).values()) == {0}


def test_linked_documents_share_a_shingle_that_is_early_in_both(spark):
    texts = [prose(9, 200)] + [edited(prose(9, 200), k, 40) for k in range(30)] + [prose(k, 60 + k) for k in range(40, 60)] + ["one", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    none = np.empty(0, np.int64)
    rows = jaccard_join._postings(docs, none, none, 1.0).collect()
    edges, h = jaccard_join.shingle_sets(Words(*buffer_of(pa.array(texts, pa.large_string()))))
    whole = {jaccard_join.node_of(h[a:b]): set(h[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:])}
    early, listed = {}, {}
    for r in rows:
        listed.setdefault(r.node, set()).add(r.shingle)
        if r.n % 2:
            early.setdefault(r.node, set()).add(r.shingle)
        assert r.n // 2 == len(whole[r.node])
    links = 0
    for a, s in whole.items():
        n = len(s)
        assert len(early[a]) == n - jaccard_join.needed(n) + 1 <= len(listed[a]) < max(n, 2)
        for b, t in whole.items():
            if a < b and 100 * len(s & t) >= jaccard_join.PERCENT * len(s | t):
                links += 1
                assert early[a] & early[b]
    assert links > 20


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.data())
def test_lists_are_probed_at_once(sets, data):
    lists = jaccard_join.Lists([sorted(s) for s in sets])
    x = data.draw(st.integers(0, len(sets) - 1))
    begin, _ = lists.before(x)
    docs = np.array(sorted(data.draw(st.sets(st.integers(0, max(0, x - 1)), min_size=1))), np.int64)
    earlier = {e for s in sets[:x] for e in s} & sets[x]
    assert lists.probed(begin, docs).tolist() == [len(earlier & sets[y]) for y in docs]


def test_passages_of_which_every_part_is_common_elsewhere(spark):
    """Each run of words that the two of a pair share is in 40 or 1,140 others, too, so neither is next to
    the other in a list."""
    rows, meant = [], set()
    for k in range(3):
        parts = [" ".join(prose(9100 + 10 * k + i, 20).split()[:12]) for i in range(5)]
        for side in (0, 1):
            rows.append((2 * k + side, f"{prose(9200 + 2 * k + side, 60)}\n" + " ".join(f"{p} odd{k}x{side}x{i}" for i, p in enumerate(parts)) + f"\n{prose(9300 + 2 * k + side, 40)}"))
        meant.add((2 * k, 2 * k + 1))
        rows += [(1000 * (k + 1) + n, " ".join([*(f"a{k}x{n}x{j}" for j in range(30)), p, *(f"b{k}x{n}x{j}" for j in range(30))])) for i, p in enumerate(parts) for n in range(100 * i, 100 * i + 40)]
        rows += [(10_000 * (k + 1) + n, " ".join([*(f"c{k}x{n}x{j}" for j in range(25)), parts[0], *(f"d{k}x{n}x{j}" for j in range(25))])) for n in range(1100 if k == 0 else 0)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_doc_id))) for r in found} == meant
    assert all(r.common_words >= 60 for r in found)


def test_a_passage_of_two_passages_is_reported_whole(spark):
    first, second = (" ".join(prose(k, 80).split()[:60]) for k in (8801, 8802))
    rows = [(k, f"{prose(8900 + k, 60)}\n{(first, second)[k % 2]}\n{prose(9000 + k, 60)}") for k in range(80)]
    rows += [(k, f"{prose(8500 + k, 60)}\n{first}\n{second}\n{prose(8700 + k, 60)}") for k in (500, 501)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert any({r.doc_id, r.other_doc_id} == {500, 501} and r.common_words >= 120 for r in found)
    one = groups([*range(80), 500, 501], [(r.doc_id, r.other_doc_id) for r in found])
    assert set(one.values()) == {0}  # linked by the documents that have both


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.lists(st.tuples(st.integers(-2, 2), st.integers(0, 1), st.integers(1, 4), st.integers(0, 9)), max_size=40))
def test_packed_seeds_keep_every_occurrence(buckets, occurrences):
    rows = [tuple(np.array(c, np.int64) for c in zip(*([(k, 2 * p + 1, n, pos) for k, p, n, pos in some]))) for some in (occurrences[::2], occurrences[1::2]) if some]
    batches = [substring_dedup._packed([x], buckets) for x in rows]
    got = set()
    for b in batches:
        for bucket, seed, part, node, times, pos in zip(*(b.column(i).to_pylist() for i in range(6))):
            own = np.repeat(np.frombuffer(node, np.int64), substring_dedup._of_planes(times))
            got |= set(zip([bucket] * len(own), substring_dedup._of_planes(part).tolist(), own.tolist(), substring_dedup._of_planes(pos).tolist()))
            assert len(seed) == substring_dedup.SEED_BYTES * len(own)
    assert {x[1:] for x in got} == {(2 * p + 1, n, pos) for _, p, n, pos in occurrences} and all(0 <= x[0] < buckets for x in got)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=7, max_size=7), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 5), min_size=7, max_size=7), min_size=1, max_size=5))
def test_common_words_in_any_order_are_counted(rows, others):
    count = lambda x, y: sum(min(x.count(w), y.count(w)) for w in range(1, 6))
    got = substring_dedup.common_counts(np.array(rows, np.uint16), np.array(others, np.uint16))
    assert got.tolist() == [[count(x, y) for y in others] for x in rows]
