"""Quality rules as a short-circuit cascade.

A rule rejects texts. On a bounded sample each rule's cost (CPU seconds a text) and its
rejections are measured; the rules are then ordered by rejections per cost, each one judged on
the texts that the rules before it leave. The cascade works on the surviving texts only: a
text that one rule rejects costs the later rules nothing. The verdict does not depend on the
order, so a noisy measurement changes the time and never the result.

Defined results: a null text is an empty one and is rejected (no words); repeated rows are
judged alike, row by row; an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.rows import mapped
from countcast.llm.words import Words, mixed, span_hashes, text_slices

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Texts in the sample on which the cascade is planned (about; never more than twice as many).
SAMPLE_TEXTS = 2000


def _lookup(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters.encode("ascii"), np.uint8)] = True
    return table


_SYMBOL = _lookup(SYMBOLS)
_UPPER = _lookup("".join(map(chr, range(65, 91))))
_LETTER = _UPPER | _lookup("".join(map(chr, range(97, 123))))
_WORDLIKE = _LETTER.copy()
_WORDLIKE[128:] = True


def n_symbols(w: Words) -> np.ndarray:
    return w.sums(_SYMBOL[w.data])


def word_chars(w: Words) -> np.ndarray:
    """Code points in words: bytes that begin a character, without white space."""
    space = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
    return w.sums(((w.data & 0xC0) != 0x80) & ~space)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every line that has a word."""
    at = np.flatnonzero(w.data == 10)
    # a text's first line begins at its edge; every later one behind a line feed
    starts = np.concatenate((w.edges[:-1], at + 1))
    text = np.concatenate((np.arange(w.texts), np.searchsorted(w.edges, at, side="right") - 1))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.append(starts[1:] - 1, w.edges[-1])
    last = np.append(text[1:] != text[:-1], True)
    ends[last] = w.edges[1:][text[last]]
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    return text[has_word], starts[has_word], ends[has_word]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def line_counts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line) of each text."""
    text, starts, ends = _lines(w)
    keys = mixed(span_hashes(w.data, starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    new = np.unique(keys, return_index=True)[1]
    lines = np.bincount(text, minlength=w.texts)
    distinct = np.bincount(text[new], minlength=w.texts)
    return lines, lines - distinct


def n_dup_lines(w: Words) -> np.ndarray:
    return line_counts(w)[1]


def n_repeat_words(w: Words) -> np.ndarray:
    """Words in windows of three words that the text has twice or more."""
    at, h = w.windows(w.hashes, 3)
    again = at[_repeated(mixed(h + w.text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    marks = np.zeros(len(w.starts) + 2, bool)
    for i in range(3):
        marks[again + i] = True
    return w.word_sums(marks[: len(w.starts)])


def _upper_case(w: Words) -> np.ndarray:
    return 2 * w.sums(_UPPER[w.data]) > w.sums(_LETTER[w.data])


def _exclaimed(w: Words) -> np.ndarray:
    return 10 * w.sums(w.data == 33) > w.counts


def _few_letters(w: Words) -> np.ndarray:
    letters = np.concatenate(([0], np.cumsum(_WORDLIKE[w.data], dtype=np.int64)))
    return 10 * w.word_sums(letters[w.ends] > letters[w.starts]) < 8 * w.counts


def _word_length(w: Words) -> np.ndarray:
    chars = word_chars(w)
    return (2 * chars < 5 * w.counts) | (chars > 15 * w.counts)


def _dup_lines(w: Words) -> np.ndarray:
    lines, again = line_counts(w)
    return 100 * again > 35 * lines


@dataclass(frozen=True)
class Rule:
    """``rejects`` marks the texts that the rule turns down."""

    name: str
    rejects: Callable[[Words], np.ndarray]


#: Rejects by themselves what no document may be: too short, or mostly repetition.
BASE = (
    Rule("few_words", lambda w: w.counts < 50),
    Rule("repeated_words", lambda w: 100 * n_repeat_words(w) > 50 * w.counts),
)
#: The rules of the cascade; thresholds are ratios in whole numbers, so they are exact.
RULES = BASE + (
    Rule("symbols", lambda w: 10 * n_symbols(w) > w.counts),
    Rule("duplicate_lines", _dup_lines),
    Rule("upper_case", _upper_case),
    Rule("exclamations", _exclaimed),
    Rule("words_without_letters", _few_letters),
    Rule("word_length", _word_length),
)


def _subset(w: Words, rows: np.ndarray) -> Words:
    """The texts marked in ``rows``, copied together."""
    lengths = np.diff(w.edges)
    return Words(w.data[np.repeat(rows, lengths)], np.concatenate(([0], np.cumsum(lengths[rows]))))


def cascade(w: Words, rules: Sequence[Rule]) -> np.ndarray:
    """Indices of the texts no rule rejects; each rule sees only what the ones before it left."""
    alive = np.arange(w.texts)
    for rule in rules:
        if not len(alive):
            break
        keep = ~rule.rejects(w)
        if not keep.all():
            alive, w = alive[keep], _subset(w, keep)
    return alive


def kept_texts(w: Words, rules: Sequence[Rule]) -> np.ndarray:
    out = np.zeros(w.texts, bool)
    out[cascade(w, rules)] = True
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE_TEXTS) -> list[Rule]:
    """The rules in the order of rejections per CPU second, measured on a sample of texts."""
    rules = list(rules)
    rows = docs.count()
    if not rows:
        return rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in text_slices(batch, "text"):
                seconds, mask = [], np.zeros(w.texts, np.int64)
                w.hashes  # noqa: B018  shared by the rules: no single rule's cost
                for i, rule in enumerate(rules):
                    start = time.thread_time()
                    rejected = rule.rejects(w)
                    seconds.append(time.thread_time() - start)
                    mask |= rejected.astype(np.int64) << i
                yield pa.RecordBatch.from_pydict(
                    {"rejected_by": [mask.tolist()], "seconds": [seconds]},
                    schema=pa.schema({"rejected_by": pa.list_(pa.int64()), "seconds": pa.list_(pa.float64())}),
                )

    some = docs.select(F.col(text).alias("text"))
    if rows > sample:
        some = some.sample(fraction=sample / rows, seed=7).limit(2 * sample)
    measured = some.mapInArrow(measure, "rejected_by array<bigint>, seconds array<double>").collect()
    masks = np.array([m for r in measured for m in r["rejected_by"]], np.int64)
    cost = np.sum([r["seconds"] for r in measured], axis=0) / max(1, len(masks)) if measured else np.ones(len(rules))
    order: list[Rule] = []
    left = list(range(len(rules)))
    while left:
        gain = {i: np.count_nonzero(masks >> i & 1) / max(cost[i], 1e-9) for i in left}
        best = max(left, key=lambda i: (gain[i], -cost[i], -i))
        order.append(rules[best])
        left.remove(best)
        masks = masks[(masks >> best & 1) == 0]
    return order


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, all their columns unchanged."""
    order = plan(docs, rules, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in text_slices(batch, text):
                yield rows.filter(pa.array(kept_texts(w, order)))

    return mapped(docs, run, docs.schema)


#: Columns of ``judge``.
JUDGED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with the counts, whether it fails the base rules, and whether it is kept.

    The counts are asked for of every text, so the base rules cost nothing more; the cascade
    of the other rules runs on what they leave.
    """
    order = plan(docs, [r for r in rules if r not in BASE], text)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *JUDGED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in text_slices(batch, text):
                repeats = n_repeat_words(w)
                failed = (w.counts < 50) | (100 * repeats > 50 * w.counts)
                kept = np.zeros(w.texts, bool)
                good = np.flatnonzero(~failed)
                kept[good[cascade(_subset(w, ~failed), order)]] = True
                counts = (w.counts, word_chars(w), n_symbols(w), n_dup_lines(w), repeats)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept)],
                    names=schema.names,
                )

    return docs.select(key, text).mapInArrow(run, schema)
