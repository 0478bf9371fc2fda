"""Round trips: packed ids, token files, pieces and archives."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from countcast.llm import queries, sentence_pieces, token_files, warc
from countcast.llm.files import fresh_folder
from countcast.llm.words import Words, buffer_of
from tests.llm.conftest import prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_packed_ids_come_back(ids, block):
    words, offsets, escapes = token_files.pack(np.array(ids, np.uint64), block)
    assert token_files.unpack(words, offsets, escapes, len(ids), block).tolist() == ids
    for b in range(len(offsets) - 1):  # a block decodes without the others
        part = ids[b * block : (b + 1) * block]
        own = words[offsets[b] : offsets[b + 1]]
        assert token_files.unpack(own, np.array([0, len(own)]), escapes, len(part), block).tolist() == part


@pytest.mark.parametrize("top", [1, 2, 5, 12, 16, 20, 30, 31, 61])
@pytest.mark.parametrize("block", [7, 64])
def test_each_word_takes_the_most_ids_that_fit(top, block):
    """Also at the ends of blocks, where fewer ids are left than the densest sure selector holds."""
    rng = np.random.default_rng(top)
    ids = rng.integers(0, 1 << top, 500, dtype=np.uint64)
    ids[rng.random(500) < 0.5] %= np.uint64(4)
    bits, at, chosen = token_files.widths(ids), 0, []
    while at < 500:
        left = min(500 - at, block - at % block)
        best, took = (0, 1) if bits[at] > 60 else (14, 1)
        for s in range(13, 0, -1):
            take = min(int(token_files.COUNTS[s]), left)
            if take > took and (bits[at : at + take] <= token_files.BITS[s]).all():
                best, took = s, take
        chosen.append(best)
        at += took
    words, _, _ = token_files.pack(ids, block)
    assert (words >> np.uint64(60)).tolist() == chosen


def test_small_ids_share_words():
    words, _, escapes = token_files.pack(np.ones(6000, np.uint64))
    assert len(words) <= 6000 / 60 + 2 and not len(escapes)


def expected(docs, plain: bool = False) -> list[tuple]:
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = plain
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, out = 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_hold_the_library_s_ids(spark, documents, odd, empty):
    assert sorted(tuple(r) for r in token_files.token_index(spark, documents, VOCABULARY).collect()) == expected(documents)
    got = token_files.token_index(spark, odd, VOCABULARY).collect()
    lengths = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)
    assert lengths == sorted((k is not None, k or 0, n, c) for k, _, n, c in expected(odd))
    assert token_files.token_index(spark, empty, VOCABULARY).count() == 0


def test_special_tokens_may_be_ordinary_text(spark, odd):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_files.token_index(spark, odd, VOCABULARY, plain=True).collect())
    assert got == sorted((k is not None, k or 0, n, c) for k, _, n, c in expected(odd, plain=True))
    assert expected(odd, plain=True) != expected(odd)


def test_long_words_are_told_apart(spark):
    """Two words of 1,024 letters that a polynomial modulo 2 ** 64 gives the same value."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, one)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in token_files.token_index(spark, docs.coalesce(1), VOCABULARY).collect()) == expected(docs)


def test_op3_gives_special_tokens_their_ids_as_the_library_does(spark, documents, tmp_path):
    special = ["end of it<|endoftext|> next", "a<|endoftext|>b", "<|endoftext|>", "x.<|endoftext|><|endoftext|>  y\n <|endoftext|> z", "<|endof text|> <|endoftext", "no|> <|<|endoftext|>|>"]
    added = spark.createDataFrame([(100_000 + k, t) for k, t in enumerate(special)], "doc_id bigint, text string")
    documents.select("doc_id", "text").limit(40).unionByName(added).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert tokenizer.encode(special[0], add_special_tokens=False).ids == [437, 286, 340, 50256, 1306]
    assert sorted(tuple(r) for r in queries.op3_token_files(spark, str(tmp_path)).collect()) == want


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces.load(MODEL)


def brute(pieces, word: str) -> float:
    """Score of the best segmentation, every substring tried."""
    scores = {p: s for p, (_, _, s) in pieces.automaton.items()}
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + sentence_pieces.BYTE_SCORE * len(word[end - 1].encode())
        for start in range(end):
            best[end] = max(best[end], best[start] + scores.get(word[start:end], -math.inf))
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="theinga 日é\n▁", max_size=40))
def test_viterbi_finds_the_best_score(pieces, text):
    marked = sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)
    scores = {i: s for _, (i, _, s) in pieces.automaton.items()}
    got = sum(scores.get(i, sentence_pieces.BYTE_SCORE) for i in pieces._plain(marked))
    assert got == pytest.approx(brute(pieces, marked))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_pieces_give_the_text_back(pieces, text):
    assert pieces.decode(pieces.encode(text)) == text


def test_piece_columns(odd, empty):
    rows = sentence_pieces.decode(sentence_pieces.encode(odd, MODEL), MODEL).collect()
    assert len(rows) == odd.count() and all(r.decoded == r.text for r in rows)
    digests = sentence_pieces.digests(odd, MODEL).collect()
    assert all(r.restored for r in digests) and {r.n_tokens for r in digests if r.doc_id == 3} == {0}
    assert sentence_pieces.digests(empty, MODEL).count() == 0


def test_archives_give_the_pages_back(spark):
    long = prose(4, 60_000)
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: 1", "same"), (3, None, long), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same"), (2, "http://b", "same"), (9, "http://g", "é" * 70_000), (9, "http://g", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, record string, chunk string")
    got = warc.archive_index(spark, pages).collect()
    want = []
    for body in {r[2] or "" for r in rows}:
        ids = sorted((r[0] for r in rows if (r[2] or "") == body), key=lambda k: (k is not None, k or 0))
        data = body.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((ids[-1], len(data), digest, "response", None))
        want += [(k, len(data), digest, "revisit", ids[-1]) for k in ids[:-1]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archive_index(spark, pages.limit(0)).count() == 0


def test_large_payloads_are_read_in_chunks(spark):
    body = prose(5, 20_000)
    pages = spark.createDataFrame([(1, "http://a", body)], "page_id bigint, url string, html string")
    archives = warc.write_archives(warc.record_chunks(pages, chunk_bytes=1000), fresh_folder(spark, "warc"))
    rows = sorted(warc.read_archives(archives, chunk_bytes=777).collect(), key=lambda r: r.chunk)
    assert len(rows) > 100 and max(len(r.data) for r in rows) <= 777
    assert b"".join(r.data for r in rows) == body.encode()
    assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    assert [r.digest is None for r in rows] == [True] * (len(rows) - 1) + [False]


def test_segments_seen_before_are_not_looked_up_one_by_one():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    text = prose(7, 20_000)
    encode = token_files.Encoder(VOCABULARY)
    encode.known = Counted()
    once = [x.tolist() for x in encode(texts_of([text]))]
    new, Counted.asked = Counted.asked, 0
    assert [x.tolist() for x in encode(texts_of([text]))] == once
    assert new > 10 * Counted.asked


@pytest.mark.parametrize("places", [1, 3, 19])
def test_ids_do_not_depend_on_the_places_of_segments(monkeypatch, places):
    monkeypatch.setattr(token_files, "_PLACES", places)
    encode = token_files.Encoder(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    odd = ["", "a", "a\0", "\0a", "\0" * 9, "x" * 14, "x" * 15, "x" * 16, " " + "é" * 7, "word " * 40, "a b\0 b b\0\0", "<|endoftext|> 'tis", "日本 語 12,5%\tz"]
    for texts in (odd, odd[::-1], [prose(k, 60) for k in range(20)] + odd):
        ids, counts = encode(texts_of(texts))
        wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in wanted]
        assert ids.tolist() == [i for x in wanted for i in x]


def texts_of(texts: list[str]) -> Words:
    return Words(*buffer_of(pa.array(texts, pa.large_string())))
