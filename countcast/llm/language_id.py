"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability
of a word is the sum over all ways of cutting it into pieces, found by a forward pass: the
places of a word are passed once, each one adding up the pieces that end there (an
Aho-Corasick automaton lists them). A character that is no piece stands for its UTF-8 bytes, so
every word has a segmentation. A text's score is the sum of its words' log-probabilities and the
log share of the language among the labelled texts.

The piece probabilities are fitted by expectation maximisation: forward and backward passes over
the distinct words of each language give the expected number of times each piece is used. The
fit sees the words of a bounded sample of labelled texts, about ``sample`` a language, chosen
by a hash of the text so that neither layout nor order matters; shares of languages count all
labelled texts, and every text is scored whole. The driver and each task hold one
probability for each piece and language; nothing there grows with the number of texts.

Words are runs of bytes other than ASCII white space, without the ASCII digits and punctuation
at their ends; those without a letter say nothing about a language and are passed over. A word
counts each time it appears, but is computed once for many: a Python worker remembers words
(KNOWN at most, then it starts anew), and works on all new words of a megabyte of text together.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a word of any
length is scored whole; of languages with equal scores the first by name wins; repeated rows
have equal results; without a labelled text every text is ``und``; a null label is none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.quality_classifier import held_out
from countcast.llm.words import text_slices
from countcast.workspace import stored

#: The mark in front of a word (fixed by the vocabulary's format), and the form of byte pieces.
MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Texts of a language, about, that the fit sees.
SAMPLE = 3000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Expected pieces that every language borrows from all languages together.
BORROWED = 2000.0
#: Words a task remembers; longer words than SHORT bytes are never remembered.
KNOWN, SHORT = 500_000, 64
#: Characters, times languages, whose forward sums are held at once.
AT_ONCE = 1 << 22
UNDETERMINED = "und"


class Lattice:
    """A vocabulary: which pieces end at which places of a word."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.bytes_at = np.zeros(256, np.int64)
        self.lengths = np.zeros(len(pieces), np.int64)
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        for i, piece in enumerate(pieces):
            if m := _BYTE.fullmatch(piece):
                self.bytes_at[int(m[1], 16)] = i
            elif piece and piece not in ("<unk>", "<s>", "</s>", "<pad>"):
                self.automaton.add_word(piece, i)
                self.lengths[i] = len(piece)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())])

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offset of each word, and the end; from, to, first piece and byte pieces of each edge).

        Word k, marked, has places offset[k] to offset[k + 1] - 1. Byte pieces are rows of four
        numbers, -1 where there is none: the UTF-8 bytes of a character that is no piece.
        """
        # words end in a character that no piece has, so no piece reaches from one into the next
        whole = "\n".join(MARK + w for w in words) + "\n"
        lengths = np.array([len(w) + 2 for w in words], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        table = np.fromiter(chain.from_iterable(self.automaton.iter(whole)), np.int64).reshape(-1, 2)
        target, piece = table[:, 0] + 1, table[:, 1]
        source = target - self.lengths[piece]
        lone = [(at, c) for c in set(whole) - self.single - {"\n"} for at in _places(whole, c)]
        spelled = np.full((len(lone), 4), -1, np.int64)
        for row, (_, c) in enumerate(lone):
            own = self.bytes_at[list(c.encode())]
            spelled[row, : len(own)] = own
        at = np.array([a for a, _ in lone], np.int64)
        pieces = np.full((len(table) + len(lone), 4), -1, np.int64)
        pieces[: len(table), 0], pieces[len(table) :] = piece, spelled
        return offsets, np.append(source, at), np.append(target, at + 1), pieces[:, 0], pieces


def _places(text: str, c: str) -> Iterator[int]:
    at = text.find(c)
    while at >= 0:
        yield at
        at = text.find(c, at + 1)


@cache
def lattice(path: str) -> Lattice:
    return Lattice.load(path)


def _edge_weights(logs: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Log-probability of each edge: the sum over its pieces. ``logs`` is pieces x languages."""
    out = logs[pieces[:, 0]].copy()
    for k in range(1, pieces.shape[1]):
        more = np.flatnonzero(pieces[:, k] >= 0)
        out[more] += logs[pieces[more, k]]
    return out


def _sums(order_by: np.ndarray, target: np.ndarray, source: np.ndarray, weight: np.ndarray, values: np.ndarray) -> None:
    """Adds up, in log space and step by step, what reaches each place.

    ``order_by`` is the step in which an edge is used; all edges into a place have the same.
    """
    order = np.lexsort((target, order_by))
    target, source, weight, step = target[order], source[order], weight[order], order_by[order]
    cuts = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
    for a, b in zip(cuts, cuts[1:]):
        t, reached = target[a:b], values[source[a:b]] + weight[a:b]
        new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        most = np.maximum.reduceat(reached, new, axis=0)
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, b - a)))
        values[t[new]] = most + np.log(np.add.reduceat(np.exp(reached - most[group]), new, axis=0))


def forward(lat: Lattice, logs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language: over all its segmentations."""
    out = np.empty((len(words), logs.shape[1]))
    at, most = 0, max(1, AT_ONCE // logs.shape[1])
    while at < len(words):
        stop, size = at + 1, len(words[at])
        while stop < len(words) and size + len(words[stop]) + 2 <= most:
            size += len(words[stop]) + 2
            stop += 1
        if size > most:
            out[at] = _long_word(lat, logs, words[at])
        else:
            offsets, source, target, _, pieces = lat.edges(words[at:stop])
            values = np.zeros((offsets[-1], logs.shape[1]))
            step = target - offsets[np.searchsorted(offsets, target, side="right") - 1]
            _sums(step, target, source, _edge_weights(logs, pieces), values)
            out[at:stop] = values[offsets[1:] - 1]
        at = stop
    return out


def _long_word(lat: Lattice, logs: np.ndarray, word: str, part: int = 1 << 14) -> np.ndarray:
    """As ``forward``, for a word longer than the sums that may be held: only the last
    places are kept, as many as the longest piece has characters."""
    reach = 1 + int(lat.lengths.max())
    total = np.zeros((1, logs.shape[1]))  # sums at the places before ``at``, the last one at it
    text, at = MARK + word, 0
    while at < len(text):
        lead = len(total) - 1  # places before ``at`` that are still known
        window = text[at - lead : at + part]
        marked = lat.edges([window[1:]]) if not at else _unmarked(lat, window)
        _, source, target, _, pieces = marked
        new = target > lead
        values = np.full((len(window) + 1, logs.shape[1]), -np.inf)
        values[: lead + 1] = total
        _sums(target[new], target[new], source[new], _edge_weights(logs, pieces[new]), values)
        at += part
        total = values[-min(reach, len(values)) :]
    return total[-1]


def _unmarked(lat: Lattice, window: str) -> tuple[np.ndarray, ...]:
    """Edges within a stretch of a word that does not begin with the mark."""
    offsets, source, target, first, pieces = lat.edges([window])
    inside = source > 0  # the mark that ``edges`` puts in front
    return offsets, source[inside] - 1, target[inside] - 1, first[inside], pieces[inside]


def expected_pieces(lat: Lattice, logs: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language, ``logs`` its pieces' log-probabilities."""
    out = np.zeros(lat.size)
    at = 0
    while at < len(words):
        stop, size = at + 1, len(words[at])
        while stop < len(words) and size < AT_ONCE // 4:
            size += len(words[stop]) + 2
            stop += 1
        offsets, source, target, _, pieces = lat.edges(words[at:stop])
        word = np.searchsorted(offsets, target, side="right") - 1
        weight = _edge_weights(logs[:, None], pieces)
        before, after = np.zeros((offsets[-1], 1)), np.zeros((offsets[-1], 1))
        _sums(target - offsets[word], target, source, weight, before)
        _sums(offsets[word + 1] - source, source, target, weight, after)
        total = before[offsets[1:] - 1, 0]
        used = np.exp(before[source, 0] + weight[:, 0] + after[target, 0] - total[word]) * times[at:stop][word]
        for k in range(pieces.shape[1]):
            more = pieces[:, k] >= 0
            np.add.at(out, pieces[more, k], used[more])
        at = stop
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Names in order, log shares, and log-probabilities (pieces x languages)."""

    languages: tuple[str, ...]
    shares: np.ndarray
    logs: np.ndarray


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities from expected counts (pieces x languages); rare pieces lean on all languages."""
    common = counts.sum(axis=1, keepdims=True) + 0.01
    common /= common.sum()
    p = counts + BORROWED * common
    return np.log(p / p.sum(axis=0))


def fit(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> LanguageModel:
    """From rows (text, lang); rows without a language are left out."""
    labelled = labelled.where("lang is not null")
    sizes = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row a language
    names = tuple(name for name, _ in sizes)
    if not names:
        return LanguageModel((), np.empty(0), np.empty((0, 0)))
    shares = np.log(np.array([n for _, n in sizes], float) / sum(n for _, n in sizes))
    limits = F.create_map(*(x for name, n in sizes for x in (F.lit(name), F.lit(min(1.0, sample / n)))))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < limits[F.col("lang")] * (1 << 30)
    number = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))))
    some = labelled.where(drawn).select(number[F.col("lang")].alias("language"), "text")
    words = stored(some.mapInArrow(_counted, "language int, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    counts = np.zeros((lattice(vocabulary).size, len(names)))
    logs = _smoothed(counts)
    for _ in range(rounds):
        use = words.mapInArrow(_expecting(vocabulary, logs), "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros_like(counts)
        found = use.toPandas()  # a row for each piece and language
        counts[found["piece"], found["language"]] = found["n"]
        logs = _smoothed(counts)
    return LanguageModel(names, shares, logs)


_ENDS = (string.digits + string.punctuation).encode()


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_ENDS) for w in text.split()]


def _has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, n) of the words with a letter, counted within a slice."""
    for batch in batches:
        for part, w in text_slices(batch, "text"):
            seen: dict[tuple[int, bytes], int] = {}
            for language, a, b in zip(part.column("language").to_pylist(), w.edges, w.edges[1:]):
                for word in words_of(w.data[a:b].tobytes()):
                    seen[language, word] = seen.get((language, word), 0) + 1
            rows = [(language, s, n) for (language, word), n in seen.items() if _has_letter(s := word.decode())]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()))], names=["language", "word", "n"])


def _expecting(vocabulary: str, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        total = np.zeros(logs.shape)
        for batch in batches:
            language = batch.column("language").to_numpy()
            times = batch.column("n").to_numpy()
            for k in np.unique(language):
                rows = np.flatnonzero(language == k)
                total[:, k] += expected_pieces(lat, logs[:, k], batch.column("word").take(pa.array(rows)).to_pylist(), times[rows])
        piece, language = np.nonzero(total)
        columns = [pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, language])]
        yield pa.RecordBatch.from_arrays(columns, names=["language", "piece", "n"])

    return run


class _Scorer:
    """Remembers the log-probabilities of words; row 0 is for words without a letter."""

    def __init__(self, lat: Lattice, logs: np.ndarray) -> None:
        self.lat, self.logs = lat, logs
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows, self.used = np.zeros((1024, self.logs.shape[1])), 1

    def _add(self, new: np.ndarray) -> None:
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.used : self.used + len(new)] = new
        self.used += len(new)

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the texts' words."""
        if len(self.known) > KNOWN:
            self.forget()
        known = self.known
        new = list({w for words in texts for w in words if w not in known})
        decoded = [w.decode() for w in new]
        lettered = [k for k, w in enumerate(decoded) if _has_letter(w)]
        known.update(dict.fromkeys(new, 0))
        known.update((new[k], self.used + i) for i, k in enumerate(lettered))
        if lettered:
            self._add(forward(self.lat, self.logs, [decoded[k] for k in lettered]))
        out = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]
        for w in new:
            if len(w) > SHORT:
                del known[w]
        return out


#: The scorer of the model that this Python worker used last, by the model's digest.
_last: dict[str, _Scorer] = {}


def _scorer(digest: str, vocabulary: str, logs: np.ndarray) -> _Scorer:
    if digest not in _last:
        _last.clear()
        _last[digest] = _Scorer(lattice(vocabulary), logs)
    return _last[digest]


def predict(docs: DataFrame, model: LanguageModel, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every text; the score is the language's posterior probability."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    digest = hashlib.sha256(model.logs.tobytes() + vocabulary.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(digest, vocabulary, model.logs) if model.languages else None
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                names, scores = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                if scorer:
                    rows = scorer.look_up([words_of(w.data[a:b].tobytes()) for a, b in zip(w.edges, w.edges[1:])])
                    for k, words in enumerate(rows):
                        if words.any():
                            total = scorer.rows[words].sum(axis=0) + model.shares
                            best = int(total.argmax())
                            names[k], scores[k] = model.languages[best], 1 / np.exp(total - total[best]).sum()
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def classify(docs: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS, withheld: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows that are held out teach nothing."""
    out = held_out(F.col("doc_id")) if withheld is None else withheld
    model = fit(docs.where(~out).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), vocabulary, sample, rounds)
    found = predict(docs, model, vocabulary)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out") if withheld is None else withheld.alias("held_out"), "lang_pred", "score")
