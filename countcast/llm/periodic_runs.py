"""Periodic runs of words: stretches that repeat themselves four times or more.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends. Every run of period q has a place i
on the grid 0, 3q, 6q, ... with i and i + q inside it. So the harmonic grids of all periods (n log n
places together) hold a candidate of every run; those whose two words agree ask a
run-length grammar of the texts (``recompression``) how far the agreement goes to both sides.
The extensions are exact, so no suffix array and no second check is needed: a stretch found
with several periods has the smallest of them.

Texts are worked on in slices of about a megabyte, a longer text alone; the grammar of a slice is one,
with a symbol of its own between any two texts. Memory is a small multiple of the longest text (its
words as Python objects); candidates of long texts are made and asked in parts.

Defined results: a null or empty text has no words and no runs; repeated rows have equal results; a
null key is like any other in ``scan`` (and gets no planted repetition); ties of the greatest
exponent go to the smallest start, then the smallest period; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.recompression import Grammar
from countcast.llm.words import text_slices

#: A run has this many words at least, and holds its period so many times.
LEAST, TIMES = 6, 4
#: Texts of up to this many words share one table of candidates.
SHARED_GRID = 1 << 16
#: Candidates made, and queries asked, at once.
AT_ONCE = 1 << 20

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) of the grids of periods low to high - 1 in n words."""
    periods = np.arange(low, high)
    step = (TIMES - 1) * periods
    counts = (n - 1 - periods) // step + 1
    period = np.repeat(periods, counts)
    k = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
    return k * (TIMES - 1) * period, period


@cache
def _shared_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of all texts up to SHARED_GRID words, by the number of words they need."""
    at, period = _grid(SHARED_GRID, 1, SHARED_GRID // TIMES + 1)
    need = np.maximum(at + period + 1, TIMES * period)
    order = np.argsort(need, kind="stable")
    return need[order].astype(np.int32), at[order].astype(np.int32), period[order].astype(np.int32)


def harmonic_grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every candidate in n words, in parts of bounded size."""
    if n <= SHARED_GRID:
        need, at, period = _shared_grid()
        stop = int(np.searchsorted(need, np.int32(n), side="right"))
        yield at[:stop], period[:stop]
        return
    low, last = 1, n // TIMES
    while low <= last:
        high = low + 1
        made = n // ((TIMES - 1) * low) + 1
        while high <= last and made < AT_ONCE:
            made += n // ((TIMES - 1) * high) + 1
            high += 1
        yield _grid(n, low, high)
        low = high


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each text as rows (start, length, period), by start, then period.

    A text is an array of symbols from 0 on; equal symbols are equal words.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    known = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    # a separator before every text, and one at the end
    edges = np.concatenate(([0], np.cumsum(sizes + 1)))
    whole = np.empty(edges[-1] + 1, np.int64)
    whole[edges] = known + np.arange(len(edges))
    for t, at in zip(texts, edges):
        whole[at + 1 : at + 1 + len(t)] = t
    grammar = Grammar(whole)
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    asked = 0

    def ask() -> None:
        nonlocal asked
        if not waiting:
            return
        at = np.concatenate([w[0] for w in waiting])
        period = np.concatenate([w[1] for w in waiting]).astype(np.int64)
        waiting.clear()
        asked = 0
        right = grammar.extensions(at, at + period, 1)
        enough = np.maximum(LEAST, TIMES * period)
        left = grammar.extensions(at - 1, at + period - 1, -1)
        start, length = at - left, left + period + right
        run = length >= enough
        found.append(np.unique(np.column_stack((start[run], length[run], period[run])), axis=0))

    for at, n in zip(edges, sizes):
        if n < LEAST:
            continue
        for place, period in harmonic_grid(int(n)):
            first = place + (at + 1)
            hit = whole[first] == whole[first + period]
            if hit.any():
                waiting.append((first[hit], period[hit]))
                asked += len(waiting[-1][0])
                if asked >= AT_ONCE:
                    ask()
    ask()
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    if len(rows):  # sorted by (start, length, period): the first of a stretch has its smallest period
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    bounds = np.searchsorted(rows[:, 0], edges)
    return [rows[a:b] - (e + 1, 0, 0) for a, b, e in zip(bounds, bounds[1:], edges)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones, the first."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def _searched(batches: Iterator[pa.RecordBatch], edit: Edit | None) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[np.ndarray]]]:
    """Slices of rows (key, text), with the words and runs of each row."""
    for batch in batches:
        for part, w in text_slices(batch, "text"):
            texts = [w.data[a:b].tobytes().split() for a, b in zip(w.edges, w.edges[1:])]
            if edit:
                texts = [edit(key, words) for key, words in zip(part.column("key").to_pylist(), texts)]
            known: dict[bytes, int] = {}
            symbols = [np.array([known.setdefault(x, len(known)) for x in words], np.int64) for words in texts]
            yield part, texts, find_runs(symbols)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """(key, start, length, period) of every run of every text.

    ``edit`` may change a text's words before the search, given its key.
    """
    names = [key, "start", "length", "period"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, runs in _searched(batches, edit):
            rows = np.concatenate(runs)
            owner = np.repeat(np.arange(part.num_rows), [len(r) for r in runs])
            columns = [part.column("key").take(pa.array(owner)), *(pa.array(rows[:, c]) for c in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _rows(docs, key, text).mapInArrow(run, schema)


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): each run cut to its first period, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, runs in _searched(batches, None):
            out = [b" ".join(compress(words, kept_words(len(words), r))).decode() for words, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], names=[key, text])

    return _rows(docs, key, text).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField(text, T.StringType())]))


#: Columns of ``summaries`` behind the key.
SUMMARY = ("n_runs", "start", "length", "period", "exponent_milli")


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """One row of each text: its number of runs, the run of greatest exponent, and two digests.

    ``runs_sha256`` is of ``start,length,period`` lines, ``collapsed_sha256`` of the collapsed text.
    """
    digests = ("runs_sha256", "collapsed_sha256")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in (key, *SUMMARY)] + [T.StructField(n, T.StringType()) for n in digests])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _searched(batches, edit):
            rows = []
            for words, runs in zip(texts, found):
                best = best_run(runs)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
                left = b" ".join(compress(words, kept_words(len(words), runs)) if len(runs) else words)
                numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            columns = [pa.array(c, pa.int64() if k < len(SUMMARY) else pa.string()) for k, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=schema.names)

    return _rows(docs, key, text).mapInArrow(run, schema)


def with_planted_run(key: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by its key, goes on from some word by repeating a stretch.

    h is the crc32 of the decimal key. If h % 10 is 0, each word i >= a becomes word
    a + (i - a) % p, with g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    n = len(words)
    if key is None or not n:
        return words
    g, r = divmod(zlib.crc32(str(key).encode()), 10)
    if r:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]
