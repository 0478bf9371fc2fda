"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark texts are cut into passages. They are the queries; they are taken in blocks of
   bounded size, and each block is held against all documents.
2. Document frequencies of a block's words are counted over all documents.
3. A window that holds a passage has some of its rarest words (``marks``), so windows without
   them are passed over: no other can pass step 6. Documents with windows left are stored.
4. TF-IDF rows of the block's passages, and of all windows of all those documents, span the
   latent space: a randomised SVD with a power iteration, whose products with the rows are computed
   in tasks and summed by shuffles; only matrices of (words of the block) x (rank) come to the driver.
5. Every window left is projected, and the windows near a passage by cosine are
   candidates (``NEAR``; recall against brute force is measured by a test).
6. A candidate is checked by words: the longest common subsequence must hold ``COMMON`` of the
   passage, or, for a paraphrase, ``PARAPHRASED`` of it with the answer in full. The answer is
   the ``answer`` column where the benchmark has one, else the last words of the text.

Words are compared in lower case without ASCII punctuation. Defined results: null or empty
texts on either side match nothing; benchmark rows with the same text match alike; repeated
document rows are reported each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.rows import with_row_ids
from countcast.llm.words import Words, text_slices
from countcast.workspace import stored

#: Windows begin at every STEP-th word; a passage is sought in the shortest window that holds it
#: wherever it begins.
STEP = 8
WINDOWS = (24, 40, 72)
#: Longest passage; longer benchmark texts are cut into overlapping ones.
PASSAGE = WINDOWS[-1] - STEP + 1
#: Passages of the benchmark in a block (about).
BLOCK = 256
RANK, OVERSAMPLED = 160, 16
#: Cosine from which a window is a candidate.
NEAR = 0.55
COMMON, PARAPHRASED = 0.8, 0.55
#: Words at the end of a text that stand for the answer: this share, and at least so many.
ANSWER_SHARE, ANSWER_WORDS = 0.2, 4
#: Shorter common subsequences prove nothing: whole passages up to this length must be there.
SHORT = 8

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def plain_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices with the words in lower case and without ASCII punctuation."""
    for part, w in text_slices(batch, column):
        yield part, Words(_PLAIN[w.data], w.edges)


@dataclass
class Block:
    """A block of passages: their words as places in a sorted vocabulary of hashes."""

    vocabulary: np.ndarray
    items: list[int | None]
    words: list[list[int]]
    answers: list[list[int]]
    idf: np.ndarray | None = None
    space: np.ndarray | None = None  # words x rank, weighted by idf
    points: np.ndarray | None = None  # passages x rank, of length 1
    marked: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)  # by first passage: see ``marks``

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index among the text's words, place in the vocabulary) of the known words."""
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        index = np.flatnonzero(self.vocabulary[at] == w.hashes)
        return index, at[index]


def passages(benchmark: DataFrame, item: str = "item_id", text: str = "text", answer: str = "answer") -> DataFrame:
    """(item, words, answer) of every passage, words as hashes, the answer with the last one."""
    answers = F.col(answer).cast("string") if answer in benchmark.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, w in plain_slices(batch):
                own = [Words(_PLAIN[np.frombuffer((a or "").encode(), np.uint8)], np.array([0, len((a or "").encode())])).hashes for a in part.column("answer").to_pylist()]
                for i, key in enumerate(part.column("item").to_pylist()):
                    h = w.hashes[w.first[i] : w.first[i + 1]]
                    tail = own[i] if len(own[i]) else h[-max(ANSWER_WORDS, int(ANSWER_SHARE * len(h))) :]
                    step = PASSAGE // 2
                    for start in range(0, max(1, len(h) - PASSAGE + step) if len(h) > PASSAGE else 1, step):
                        piece = h[start : start + PASSAGE]
                        if len(piece):
                            out.append((key, piece.view(np.int64).tolist(), tail.view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["item", "words", "answer"])

    rows = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"), answers.alias("answer"))
    return rows.mapInArrow(run, "item bigint, words array<bigint>, answer array<bigint>")


def blocks(found: DataFrame) -> Iterator[Block]:
    """The passages in blocks of about BLOCK; each is small whatever the benchmark's size."""
    count = -(-found.count() // BLOCK)
    for b in range(count):
        part = found.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == b) if count > 1 else found
        rows = part.orderBy("item", "words").collect()
        if not rows:
            continue
        arrays = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
        tails = [np.array(r["answer"], np.int64).view(np.uint64) for r in rows]
        vocabulary = np.unique(np.concatenate(arrays + tails))
        place = lambda a: np.searchsorted(vocabulary, a).tolist()
        yield Block(vocabulary, [r["item"] for r in rows], [place(a) for a in arrays], [place(a) for a in tails])


def with_idf(block: Block, docs: DataFrame) -> int:
    """Set the idf of the block's words over all documents; the number of documents."""
    size = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, w in plain_slices(batch):
                index, at = block.known(w)
                pairs = np.unique(w.text_of[index] * size + at)
                counts[:size] += np.bincount(pairs % size, minlength=size)
                counts[size] += w.texts
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["word", "docs"])

    rows = docs.select("text").mapInArrow(run, "word bigint, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    frequency = np.zeros(size + 1)
    for r in rows:
        frequency[r["word"]] = r["docs"]
    total = int(frequency[size])
    block.idf = np.maximum(0.0, np.log((total + 1) / (frequency[:size] + 0.5)))
    return total


def marks(block: Block, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each word, passages by word, times there, least): the words marked for each
    of these passages, and how many of them, a word as often as there, a window must have
    that holds it without its answer.

    Of a passage's n words, m must then be in the window, so at most the others are missing: of its
    rarest n - m + k words, at least k are there.
    """
    key = int(mine[0])
    if key not in block.marked:
        words, times, least = [], [], []
        for p in mine:
            w = np.array(block.words[p])
            n = len(w)
            m = max(int(np.ceil(COMMON * n)), min(n, SHORT))
            k = (m + 1) // 2
            for out, x in zip((words, times), np.unique(w[np.argsort(-block.idf[w], kind="stable")][: n - m + k], return_counts=True)):
                out.append(x)
            least.append(k)
        of = np.repeat(np.arange(len(words)), [len(x) for x in words])
        words, times = np.concatenate(words), np.concatenate(times)
        order = np.argsort(words, kind="stable")
        block.marked[key] = np.searchsorted(words[order], np.arange(len(block.vocabulary) + 1)), of[order], times[order], np.array(least)
    return block.marked[key]


def answers_at(block: Block, index: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which known word, passage) where the answer of a passage begins."""
    size = len(block.vocabulary)
    by_start: dict[int, list[int]] = {}
    for p, answer in enumerate(block.answers):
        if answer:
            by_start.setdefault(answer[0] * size + (answer[1] if len(answer) > 1 else answer[0]), []).append(p)
    singles = np.array(sorted({a[0] for a in block.answers if len(a) == 1}), np.int64)
    nearby = np.append(index[1:] - index[:-1] == 1, False)[: len(index)]
    pair = at * size + np.append(at[1:], 0)[: len(at)]
    hit = nearby & np.isin(pair, np.array(sorted(by_start), np.int64))
    alone = np.isin(at, singles)
    out = []
    for i in np.flatnonzero(hit | alone):
        keys = {int(pair[i])} if hit[i] else set()
        if alone[i]:
            keys.add(int(at[i]) * size + int(at[i]))
        for p in {p for key in keys for p in by_start.get(key, ())}:
            n = len(block.answers[p])
            if at[i : i + n].tolist() == block.answers[p] and index[min(i + n, len(index)) - 1] - index[i] == n - 1:
                out.append((i, p))
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _marked(block: Block, mine: np.ndarray, step: np.ndarray, at: np.ndarray, first_step: np.ndarray, width: int, answers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the window of ``width`` steps from each step has enough words marked for a passage, or
    the begin of its answer: else it holds none.

    A word counts in the windows that begin after the step where it was before: in each once.
    ``answers`` are the steps where answers begin, and their passages.
    """
    first, passages_of, times, least = marks(block, mine)
    some = np.flatnonzero(first[at + 1] > first[at])
    step, at = step[some], at[some]
    text = np.searchsorted(first_step, step, side="right") - 1
    order = np.lexsort((step, at))
    again = np.append(False, at[order][1:] == at[order][:-1])[: len(order)]
    low = np.maximum(first_step[text], step - width + 1)
    low[order[again]] = np.maximum(low[order[again]], step[order[np.flatnonzero(again) - 1]] + 1)
    new = low <= step
    step, at, low = step[new], at[new], low[new]
    begin, many = first[at], first[at + 1] - first[at]
    entry = np.repeat(begin - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
    size, steps = len(least), int(first_step[-1])
    own = np.isin(answers[1], mine)
    begun, answered = answers[0][own], np.searchsorted(mine, answers[1][own])
    from_step = np.maximum(first_step[np.searchsorted(first_step, begun, side="right") - 1], begun - width + 1)
    up, down = np.concatenate((np.repeat(low, many), from_step)), np.concatenate((np.repeat(step, many), begun)) + 1
    of, weight = np.concatenate((passages_of[entry], answered)), np.concatenate((times[entry], least[answered]))
    count = np.bincount(np.concatenate((up, down)) * size + np.tile(of, 2), np.concatenate((weight, -weight)), (steps + 1) * size).reshape(-1, size)[:steps]
    return (np.cumsum(count, axis=0, out=count) >= least).any(axis=1)


@dataclass
class Windows:
    """The known words of a slice's texts in steps, and the windows that may hold a passage."""

    step: np.ndarray  # of each known word
    at: np.ndarray  # place of each known word in the vocabulary
    first_step: np.ndarray  # of each text
    text_of_step: np.ndarray
    known: np.ndarray  # known words before each step
    classes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # passages, first steps and last steps of windows


def windows(block: Block, w: Words) -> Windows:
    """The windows with words enough, and marked words enough, for a passage of their class."""
    index, at = block.known(w)
    per_text = -(-w.counts // STEP)  # steps of each text
    first_step = np.concatenate(([0], np.cumsum(per_text)))
    text = w.text_of[index]
    step = first_step[text] + (index - w.first[text]) // STEP
    steps = int(first_step[-1])
    text_of_step = np.repeat(np.arange(w.texts), per_text)

    def before(chosen: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.bincount(chosen, minlength=steps))))

    known = before(step)
    lengths = np.array([len(p) for p in block.words])
    which, passage = answers_at(block, index, at)
    classes = []
    for k, width in enumerate(WINDOWS if len(index) else ()):
        low = WINDOWS[k - 1] - STEP + 1 if k else 0
        mine = np.flatnonzero((lengths > low) & (lengths <= width - STEP + 1))
        if not len(mine):
            continue
        stop = np.minimum(np.arange(steps) + width // STEP, first_step[text_of_step + 1])
        some = np.flatnonzero(known[stop] - known[:-1] >= max(1.0, PARAPHRASED * lengths[mine].min()))
        if len(some):
            some = some[_marked(block, mine, step, at, first_step, width // STEP, (step[which], passage))[some]]
        if len(some):
            classes.append((mine, some, stop[some]))
    return Windows(step, at, first_step, text_of_step, known, classes)


def possible(block: Block, docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of the documents with a window that may hold a passage of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in plain_slices(batch):
                found = windows(block, w)
                if found.classes:
                    texts = np.unique(np.concatenate([found.text_of_step[some] for _, some, _ in found.classes]))
                    yield part.take(pa.array(texts))

    return docs.select("row", "doc_id", "text").mapInArrow(run, docs.select("row", "doc_id", "text").schema)


def _fit_rows(spark: SparkSession, block: Block, docs: DataFrame) -> DataFrame:
    """(words, weights): TF-IDF rows of length 1, of the passages and of the documents' windows."""
    idf, width = block.idf, WINDOWS[1]

    def weighted(at: np.ndarray) -> tuple[list[int], list[float]]:
        words, counts = np.unique(at, return_counts=True)
        weights = counts * idf[words]
        length = np.sqrt((weights**2).sum()) or 1.0
        return words.tolist(), (weights / length).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in plain_slices(batch):
                index, at = block.known(w)
                window = w.text_of[index] * (1 << 32) + (index - w.first[w.text_of[index]]) // width
                cut = np.flatnonzero(np.diff(window)) + 1
                out = [weighted(a) for a in np.split(at, cut) if len(a)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.float64()))], names=["words", "weights"])

    schema = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    own = spark.createDataFrame([weighted(np.array(p)) for p in block.words], schema)
    others = stored(docs.select("text").mapInArrow(run, schema), "windows")
    # the documents weigh as much as the passages together: they are what is sought
    weight = float(np.sqrt(len(block.words) / max(1, others.count())))
    light = others.select("words", F.transform("weights", lambda x: x * F.lit(weight)).alias("weights"))
    return own.unionByName(light)


def _summed(rows: DataFrame, size: int, right: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A right), or (A right)'(A right): partial sums of tasks, added up by blocks of rows."""
    height = right.shape[1] if gram else size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, right.shape[1]))
        for batch in batches:
            for words, weights in zip(batch.column("words"), batch.column("weights")):
                at, x = words.values.to_numpy(), weights.values.to_numpy()
                y = x @ right[at]
                if gram:
                    total += np.outer(y, y)
                else:
                    total[at] += x[:, None] * y
        starts = range(0, height, 256)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), pa.array([total[s : s + 256].tobytes() for s in starts], pa.binary())], names=["start", "part"])

    def add(group):
        parts = [np.frombuffer(p) for p in group["part"]]
        return group.iloc[:1].assign(part=[np.sum(parts, axis=0).tobytes()])

    summed = rows.mapInArrow(run, "start int, part binary").groupBy("start").applyInPandas(add, "start int, part binary").collect()
    out = np.zeros((height, right.shape[1]))
    for r in summed:
        part = np.frombuffer(r["part"]).reshape(-1, right.shape[1])
        out[r["start"] : r["start"] + len(part)] = part
    return out


def fit_space(spark: SparkSession, block: Block, docs: DataFrame) -> None:
    """Randomised SVD: a random range, one power iteration, the Gram matrix of the projection."""
    size = len(block.vocabulary)
    rows = stored(_fit_rows(spark, block, docs), "tf-idf")
    if (tasks := spark.sparkContext.defaultParallelism) > 1:  # at most; few rows are not worth more of them
        rows = rows.coalesce(tasks)
    width = min(size, RANK + OVERSAMPLED)
    right = np.random.default_rng(11).standard_normal((size, width))
    for _ in range(2):
        right = np.linalg.qr(_summed(rows, size, right, gram=False))[0]
    _, turns = np.linalg.eigh(_summed(rows, size, right, gram=True))
    space = right @ turns[:, ::-1][:, : min(width, RANK)]
    block.space = (space * block.idf[:, None]).astype(np.float32)
    points = np.array([block.space[p].sum(axis=0) for p in block.words])
    block.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        if m := row & masks.get(y, 0):
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _holds(words: list[int], answer: list[int]) -> bool:
    n = len(answer)
    return n > 0 and any(words[i : i + n] == answer for i in range(len(words) - n + 1))


def leaked(passage: list[int], answer: list[int], window: list[int]) -> tuple[int, bool, bool]:
    """(common words, whether the answer is there, whether the window holds the passage)."""
    common = common_words(passage, window)
    least = max(int(np.ceil(COMMON * len(passage))), min(len(passage), SHORT))
    there = _holds(window, answer)
    weak = len(passage) > SHORT and common >= PARAPHRASED * len(passage) and there
    return common, there, common >= least or weak


def candidates(block: Block, w: Words, near: float = NEAR) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word in the slice, passage, cosine) of the windows near a passage."""
    found = windows(block, w)
    step, at, first_step, text_of_step, known = found.step, found.at, found.first_step, found.text_of_step, found.known
    steps = len(text_of_step)
    lengths = np.array([len(p) for p in block.words])
    covered = np.zeros(steps + 1, np.int64)
    for _, some, stop in found.classes:
        np.add.at(covered, some, 1)
        np.add.at(covered, stop, -1)
    # only the steps of such windows are projected
    inside = (np.cumsum(covered)[step] > 0) & (block.idf[at] > 0)
    step, at = step[inside], at[inside]
    if not len(step):
        return
    sums = np.zeros((len(at) + 1, block.space.shape[1]), np.float32)
    np.take(block.space, at, axis=0, out=sums[1:])
    np.cumsum(sums[1:], axis=0, out=sums[1:])
    before = np.searchsorted(step, np.arange(steps + 1))  # projected words before each step
    for mine, some, stop in found.classes:
        points = sums[before[stop]] - sums[before[some]]
        norms = np.linalg.norm(points, axis=1)
        cosine = points @ block.points[mine].T
        rows, columns = np.nonzero(cosine >= near * np.maximum(norms, 1e-9)[:, None])
        enough = (known[stop[rows]] - known[some[rows]]) >= PARAPHRASED * lengths[mine[columns]]  # else nothing can follow
        for row, column in zip(rows[enough], columns[enough]):
            s = some[row]
            t = text_of_step[s]
            yield int(t), int(w.first[t] + (s - first_step[t]) * STEP), int(mine[column]), float(cosine[row, column] / max(norms[row], 1e-9))


def _searched(block: Block, docs: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, start, common_words, passage_words, answer_found, cosine): the best
    window of each passage in each document that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in plain_slices(batch):
                best: dict[tuple[int, int], tuple] = {}
                places = None
                for text, start, p, cosine in candidates(block, w):
                    if places is None:  # unknown words are told from all others by -1
                        places = np.full(len(w.starts), -1, np.int64)
                        index, at = block.known(w)
                        places[index] = at
                    passage = block.words[p]
                    width = next(x for x in WINDOWS if len(passage) <= x - STEP + 1)
                    stop = min(start + width, int(w.first[text + 1]))
                    common, there, found = leaked(passage, block.answers[p], places[start:stop].tolist())
                    if found:
                        row = (common, -start, there, cosine, len(passage))
                        best[text, p] = max(best.get((text, p), row), row)
                if best:
                    keys = sorted(best)
                    at = pa.array([t for t, _ in keys])
                    values = [best[k] for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(at), part.column("doc_id").take(at), pa.array([block.items[p] for _, p in keys], pa.int64()),
                         pa.array([-v[1] - int(w.first[t]) for v, (t, _) in zip(values, keys)], pa.int64()), pa.array([v[0] for v in values], pa.int64()),
                         pa.array([v[4] for v in values], pa.int64()), pa.array([v[2] for v in values]), pa.array([v[3] for v in values])],
                        names=["row", "doc_id", "item_id", "start", "common_words", "passage_words", "answer_found", "cosine"],
                    )

    schema = "row bigint, doc_id bigint, item_id bigint, start bigint, common_words bigint, passage_words bigint, answer_found boolean, cosine double"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """The passages of the benchmark that documents hold: see ``_searched`` for the columns."""
    spark = docs.sparkSession
    columns = [F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    docs = docs.select(F.col(row).alias("row"), *columns) if row else with_row_ids(docs.select(*columns), "row")
    out = None
    for block in blocks(stored(passages(benchmark), "passages")):
        with_idf(block, docs)
        near = stored(possible(block, docs), "possible")
        fit_space(spark, block, near)
        found = stored(_searched(block, near), "leaks")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else _searched(Block(np.zeros(1, np.uint64), [], [], []), docs.limit(0))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without a passage of the benchmark, columns unchanged."""
    name = "__row_of_table__"
    placed = with_row_ids(docs, name)
    bad = leaks(placed, benchmark, row=name).select(F.col("row").alias(name)).distinct()
    return placed.join(bad, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
