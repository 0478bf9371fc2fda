"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The pieces of a vocabulary are the patterns of an automaton. It reads a text once; at each
position the links to shorter matches (output links) list all the pieces that end there, and
each one relaxes the best score at that position. A character no piece reaches becomes byte
pieces. No piece holds certain pairs of neighbouring characters (a letter and the mark of the next word,
U+2581, for one), so the best path of a text is the best paths of the stretches between such
pairs, end to end, and the ids of a short stretch are remembered.

Scores are log-probabilities. In a vocabulary of merges the stored scores are merge ranks, not
probabilities; there the score of the piece of rank r is -log(r + 2), as Zipf's law has it.
Pieces with stored scores far below all others (runs of spaces) are user-defined: score 0 a
character, as they cannot compete with anything else.

Encoding puts a mark before the text and for each space, as the library does; decoding turns
marks into spaces and drops the first. All else is kept, so decoding gives back the text exactly
(a U+2581 of the text itself goes through bytes). Defined results: null text: null ids (as a
query column: no tokens); empty text: no ids; other columns and repeated rows are untouched.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.rows import mapped
from countcast.llm.words import text_slices

#: The mark that stands for a space and for a text's begin (fixed by the vocabulary's format).
MARK = "▁"
#: Words that a worker remembers the ids of; longer words than this are never remembered.
REMEMBERED, SHORT = 400_000, 48
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: What a byte piece costs; it is below every piece of the vocabulary.
BYTE_SCORE = -30.0


class Pieces:
    """A vocabulary as an automaton, with encoding and decoding."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        """``pieces``: (piece, score) in order of their ids; control pieces look like <name>."""
        self.bytes_of: list[bytes] = []
        self.byte_ids = {}
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if m := _BYTE.fullmatch(piece):
                self.byte_ids[int(m[1], 16)] = i
                self.bytes_of.append(bytes([int(m[1], 16)]))
                continue
            control = piece in ("<unk>", "<s>", "</s>", "<pad>")
            self.bytes_of.append(b"" if control else piece.replace(MARK, " ").encode())
            if not control and piece:
                self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        plain = [p for p, _ in pieces if not _BYTE.fullmatch(p)]
        #: Neighbours within a piece; a text may be cut between any other two characters.
        self.pairs = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        stops = MARK + "\n" if not any("\n" in q for q in self.pairs) else MARK
        inner = any(q[1] == MARK and q[0] != MARK for q in self.pairs)
        self.words = re.compile("(?s).+" if inner else f"{MARK}*[^{stops}]+|{MARK}+|\n+")
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names, raw = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
        ranks = all(s == int(s) for s in raw)  # a vocabulary of merges

        def score(piece: str, s: float) -> float:
            if s <= -1e8:
                return -1.0
            return -math.log(2.0 - s) - 1.0 if ranks else s

        return cls([(p, score(p, s)) for p, s in zip(names, raw)])

    def best_path(self, word: str) -> list[int]:
        """Ids of the best-scored segmentation; of equal ones, that with the longest last piece."""
        n = len(word)
        best = [0.0] + [-math.inf] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        at = 0  # positions up to here have their final score

        def bytes_until(stop: int) -> None:
            nonlocal at
            while at < stop:
                at += 1
                if back[at] is None:
                    best[at] = best[at - 1] + BYTE_SCORE * len(word[at - 1].encode())
                    back[at] = (-1, at - 1)

        for end, (i, length, score) in self.automaton.iter(word):
            end += 1
            bytes_until(end - 1)
            start = end - length
            total = best[start] + score
            if total > best[end]:
                best[end], back[end] = total, (i, start)
        bytes_until(n)
        out: list[int] = []
        while n:
            i, start = back[n]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in reversed(word[start:n].encode())]
            n = start
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text:  # the text's own marks must come back as such
            own = [self.byte_ids[b] for b in MARK.encode()]
            out: list[int] = []
            for k, part in enumerate(text.split(MARK)):
                out += own if k else []
                out += self._plain((MARK if not k else "") + part.replace(" ", MARK))
            return out
        return self._plain(MARK + text.replace(" ", MARK))

    def _units(self, marked: str) -> Iterator[str]:
        """Stretches that no piece reaches out of; together they are the text."""
        for word in self.words.findall(marked):
            if len(word) <= SHORT:
                yield word
                continue
            start = 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in self.pairs:
                    yield word[start:i]
                    start = i
            yield word[start:]

    def _plain(self, marked: str) -> list[int]:
        known, out = self.known, []
        for word in self._units(marked):
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.best_path(word))
                if len(word) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace")


@cache
def _pieces(path: str) -> Pieces:
    return Pieces.load(path)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns, with the piece ids of ``text`` in a new (or replaced) column."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != ids.lower()))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for part, _ in text_slices(batch, text):
                found = [None if t is None else np.array(pieces.encode(t), np.int32) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return mapped(docs, run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns, with the text of the ids in a new column; null ids give null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            texts = [None if not v.is_valid else pieces.decode(v.values.to_numpy(zero_copy_only=False)) for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_byte_tokens, ids_crc32, restored) of every text, in one pass.

    ``restored``: decoding the ids gave the text back, character for character.
    """
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_byte_tokens", "ids_crc32")]
        + [T.StructField("restored", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        is_byte = np.zeros(len(pieces.bytes_of), bool)
        is_byte[list(pieces.byte_ids.values())] = True
        for batch in batches:
            for part, _ in text_slices(batch, "text"):
                tokens, byte_tokens, sums, same = [], [], [], []
                for t in part.column("text").to_pylist():
                    ids = pieces.encode(t or "")
                    packed = np.array(ids, "<u4")
                    tokens.append(len(ids))
                    byte_tokens.append(int(np.count_nonzero(is_byte[packed])) if len(ids) else 0)
                    sums.append(zlib.crc32(packed.tobytes()))
                    same.append(pieces.decode(ids) == (t or ""))
                longs = [pa.array(c, pa.int64()) for c in (tokens, byte_tokens, sums)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *longs, pa.array(same, pa.bool_())], names=schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
