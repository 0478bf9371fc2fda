"""Token ids in binary files, packed with Simple-8b.

A 64-bit word holds a selector in its upper four bits and as many ids as fit below:

    selector   1  2  3  4  5  6  7  8  9 10 11 12 13 14
    ids       60 30 20 15 12 10  8  7  6  5  4  3  2  1
    bits       1  2  3  4  5  6  7  8 10 12 15 20 30 60

Selector 0 is an escape: the id is too wide for 60 bits and stands whole in the chunk's list of
escapes, at the index in the lower bits. Ids are packed in blocks of ``BLOCK``; the offset of
each block's first word is stored, so a block decodes without the ones before it, and all the
words of a block (or of many) decode at once in numpy.

A file is a run of chunks. A chunk holds whole documents, about ``CHUNK_IDS`` ids or one longer
document: a header, document keys, document lengths, block offsets, words, escapes. Files are
written in ascending order of the key; a table of chunks (path, offset, size, ids) is the index
by which they are read in parallel.

Defined results: a null text is an empty one and has the end id alone; null keys come first;
rows with equal keys are ordered by a hash of their text; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countcast.llm.files import fresh_folder, fresh_name, opened
from countcast.llm.words import Words, mixed, text_slices
from countcast.workspace import stored

#: Fixed values of the format: ids in a word and bits of an id, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
BLOCK = 4096
CHUNK_IDS = 1 << 19
_HEADER = struct.Struct("<4sIQQQQ")  # magic, block, documents, ids, words, escapes
_MAGIC = b"CS8B"
_LOW = np.uint64((1 << 60) - 1)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    high = ids >> np.uint64(32)
    low = np.where(high > 0, high, ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.maximum(1, np.frexp(low)[1] + np.where(high > 0, 32, 0)).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the number of words, escapes) of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    blocks, whole = -(-n // block), n // block
    # each block is a row, with zeros after it: they fit everywhere, and ``left`` does not count them
    values = np.zeros((blocks, block + int(COUNTS[1])), np.uint64 if ids.max() >> np.uint64(32) else np.uint32)
    values[:whole, :block] = ids[: whole * block].reshape(whole, block)
    values[whole:, : n - whole * block] = ids[whole * block :]
    left = np.tile(np.minimum(np.arange(block, 0, -1), 255).astype(np.uint8), (blocks, 1))  # ids to the end of the block
    left[whole:] = np.clip(n - whole * block - np.arange(block), 0, 255)
    held = np.ones((blocks, block), np.uint8)  # ids that a word beginning here takes
    selector = np.where(values[:, :block] > _LOW, 0, 14).astype(np.uint8)
    for s in range(13, 0, -1):
        fits, have, count = values < 1 << int(BITS[s]), 1, int(COUNTS[s])
        while have < count:  # whether this id and those after it fit
            step = min(have, count - have)
            fits = fits[:, :-step] & fits[:, step:]
            have += step
        fits = fits[:, :block]
        if not fits.any():
            break  # a denser selector holds more ids, each of fewer bits
        take = np.minimum(left, np.uint8(count))
        more = fits & (take > held)
        np.copyto(held, take, where=more)
        np.copyto(selector, np.uint8(s), where=more)
    steps, at, starts = held.tobytes(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    where = np.array(starts, np.int64)
    chosen, taken = selector.ravel()[where], held.ravel()[where]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        full = taken[rows] == COUNTS[s]
        for some in (rows[full], rows[~full]):  # the others are the ends of blocks
            for k in range(int(taken[some].max(initial=0))):
                some = some[taken[some] > k] if taken[some[0]] < COUNTS[s] else some
                words[some] |= ids[where[some] + k] << np.uint64(BITS[s] * k)
    offsets = np.append(np.searchsorted(where, np.arange(0, n, block)), len(words))
    return words, offsets, ids[where[chosen == 0]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of consecutive whole blocks; offsets count from the first of ``words``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    room = COUNTS[selector]
    before = np.concatenate(([0], np.cumsum(room)))
    in_block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = before[:-1] - before[offsets[:-1]][in_block]  # place in the block; only a last word has empty places
    taken = np.minimum(room, np.minimum(block, n - in_block * block) - inner)
    place = in_block * block + inner
    out = np.empty(n, np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        low = words[rows] & _LOW
        if s == 0:
            out[place[rows]] = escapes[low.astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(taken[rows].max())):
            some = taken[rows] > k
            out[place[rows][some] + k] = (low[some] >> np.uint64(BITS[s] * k)) & mask
    return out


def chunk_bytes(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    head = _HEADER.pack(_MAGIC, BLOCK, len(keys), len(ids), len(words), len(escapes))
    known = np.array([k is not None for k in keys], np.uint8)
    plain = np.array([k or 0 for k in keys], "<i8")
    parts = (known, plain, lengths.astype("<i8"), offsets.astype("<i8"), words.astype("<u8"), escapes.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document keys, their lengths, all their ids) of one chunk."""
    magic, block, docs, n, n_words, n_escapes = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    at = _HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    known, plain, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
    offsets = take("<i8", -(-n // block) + 1)
    ids = unpack(take("<u8", n_words), offsets, take("<u8", n_escapes), n, block)
    return [int(k) if known[i] else None for i, k in enumerate(plain)], lengths, ids


# --- tokens -----------------------------------------------------------------------------

#: Segments that a worker remembers the ids of; beyond, it starts anew. No result depends on it.
REMEMBERED = 1_000_000
_SHORT = 64
#: Segments of so many bytes at most are looked up at once, in a table of so many (two to this
#: power) places: each holds the last segment that came to it, whole, so that no other is taken for it.
_PACKED, _PLACES = 15, 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not _ALNUM[c] and c != 39]] = True


@cache
def _tokenizer(path: str, plain: bool):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has a task of its own
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain
    return out


@cache
def _added(path: str) -> tuple[bytes, ...] | None:
    """The strings of the vocabulary's added tokens; None if they are looked for in normalised
    text, where their places are not those of the text."""
    tokenizer = _tokenizer(path, False)
    added = tokenizer.get_added_tokens_decoder().values()
    if tokenizer.normalizer is not None and any(t.normalized for t in added):
        return None
    return tuple(t.content.encode() for t in added if t.content)


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes where white space beyond ASCII (or a separator control) begins."""
    b = np.concatenate((data, np.zeros(2, np.uint8)))
    one, two, three = b[:-2], b[1:-1], b[2:]
    out = (one >= 0x1C) & (one <= 0x1F)
    if (data >= 0x80).any():
        out |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        out |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
        general = (three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)
        out |= (one == 0xE2) & (two == 0x80) & general
        out |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
        out |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return out


def segments(w: Words, added: tuple[bytes, ...] | None = ()) -> np.ndarray:
    """Byte offsets where the texts can be cut without changing any id, edges included.

    Byte-level BPE of this kind merges within matches of a pattern that never reach past a
    single white space character between two others, nor from an ASCII letter or digit to
    punctuation (but for the apostrophe). Texts with other white space are not cut at all, and none
    is cut within ``added`` tokens or at their ends, nor at all if those are None.
    """
    data = w.data
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        cut[1:-2] = space[1:-1] & ~space[:-2] & ~space[2:]
    if len(data) > 1:
        cut[1:-1] |= _ALNUM[data[:-1]] & _PUNCT[data[1:]]
    odd = _odd_space(data)
    if odd.any():
        cut[:-1][np.repeat(w.sums(odd) > 0, np.diff(w.edges))] = False
    if added is None:
        cut[:] = False
    elif added:
        raw = data.tobytes()
        for token in added:
            at = raw.find(token)
            while at >= 0:
                cut[at : at + len(token) + 1] = False
                at = raw.find(token, at + 1)
    cut[w.edges] = True
    return np.flatnonzero(cut)


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of 1 to _PACKED bytes as two numbers each: the bytes, and their number on top."""
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(16, np.uint8))), 8)
    low = eights[starts].view("<u8").ravel() & _FIRST_BYTES[np.minimum(lengths, 8)]
    high = eights[starts + 8].view("<u8").ravel() & _FIRST_BYTES[np.maximum(lengths - 8, 0)]
    return low, high | lengths.astype(np.uint64) << np.uint64(56)


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of short segments remembered."""

    def __init__(self, path: str, plain: bool = False) -> None:
        self.path, self.plain = path, plain
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.count = 0  # segments numbered so far
        self.starts = np.zeros(1024, np.int64)  # of each numbered segment's ids, and the end
        self.ids = np.empty(4096, np.uint32)
        self.low, self.high = np.zeros((2, 1 << _PLACES), np.uint64)  # no segment has a length of 0
        self.number = np.zeros(1 << _PLACES, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        found: list[list[int]] = []
        for at in range(0, len(new), 4096):
            texts = [s.decode() for s in new[at : at + 4096]]
            found += [e.ids for e in _tokenizer(self.path, self.plain).encode_batch_fast(texts, add_special_tokens=False)]
        count, first = self.count + len(new), int(self.starts[self.count])
        self.known.update(zip(new, range(self.count, count)))
        ends = np.cumsum([len(f) for f in found], dtype=np.int64) + first
        last = int(ends[-1])
        if count >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(count, np.int64)))
        if last > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(last, np.uint32)))
        self.starts[self.count + 1 : count + 1] = ends
        self.ids[first:last] = np.fromiter(chain.from_iterable(found), np.uint32, last - first)
        self.count = count

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, number of ids of each text)."""
        edges = segments(w, () if self.plain else _added(self.path))
        if len(edges) < 2:
            return np.empty(0, np.uint32), np.zeros(w.texts, np.int64)
        if len(self.known) > REMEMBERED or self.starts[self.count] > 16 * REMEMBERED:
            self.forget()
        sizes = np.diff(edges)
        at = np.full(len(sizes), -1)
        short = np.flatnonzero((sizes > 0) & (sizes <= _PACKED))
        low, high = packed(w.data, edges[short], sizes[short])
        place = (mixed(low ^ high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PLACES)).astype(np.int64)
        here = (self.low[place] == low) & (self.high[place] == high)
        at[short[here]] = self.number[place[here]]
        others = np.flatnonzero(at < 0)
        raw = w.data.tobytes()
        found = [raw[a:b] for a, b in zip(edges[others].tolist(), edges[others + 1].tolist())]
        numbers = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            missing = [found[i] for i in unknown.tolist()]
            new = list(dict.fromkeys(missing))
            self._learn(new)
            numbers[unknown] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
            for segment in new:  # long ones are not looked up again: they only take room
                if len(segment) > _SHORT:
                    del self.known[segment]
        at[others] = numbers
        away = np.flatnonzero(~here)
        taken, last = np.unique(place[away], return_index=True)  # one of those that come to a place
        away = away[last]
        self.low[taken], self.high[taken], self.number[taken] = low[away], high[away], at[short[away]]
        lengths = self.starts[at + 1] - self.starts[at]
        total = np.concatenate(([0], np.cumsum(lengths)))
        source = np.repeat(self.starts[at] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[source], np.diff(total[np.searchsorted(edges[:-1], w.edges)])


@cache
def _encoder(path: str, plain: bool) -> Encoder:
    return Encoder(path, plain)


# --- files ------------------------------------------------------------------------------

#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20
CHUNKS = "shard int, chunk int, path string, offset bigint, bytes bigint, n_docs bigint, n_ids bigint"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """Write the ids of every text and return the table of chunks, itself stored.

    ``plain``: strings of special tokens in a text are ordinary text; else they get their own ids,
    as the library does it by default.

    Rows are dealt by ranges of the key, so a shard is a range and shards are in order. One
    task streams its shard: it holds one chunk of ids, whatever the shard's size.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = _encoder(vocabulary, plain)
        uri = fresh_name(folder, ".s8b")
        where, path = opened(uri)
        out, rows, offset = None, [], 0
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal out, offset, held
            if not keys:
                return
            every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            data = chunk_bytes(keys, np.concatenate(lengths), every)
            out = out or where.open_output_stream(path)
            out.write(data)
            rows.append((shard, len(rows), uri, offset, len(data), len(keys), len(every)))
            offset += len(data)
            keys.clear(), lengths.clear(), ids.clear()
            held = 0

        for batch in batches:
            for part, w in text_slices(batch, "text"):
                found, counts = encode(w)
                if end_id is not None:
                    found = np.insert(found, np.cumsum(counts), end_id)
                    counts = counts + 1
                keys += part.column("key").to_pylist()
                lengths.append(counts)
                ids.append(found)
                held += len(found)
                if held >= CHUNK_IDS:
                    flush()
        flush()
        if out:
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "chunk", "path", "offset", "bytes", "n_docs", "n_ids"), r)) for r in rows],
                schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("path", pa.string())] + [(n, pa.int64()) for n in ("offset", "bytes", "n_docs", "n_ids")]),
            )

    ordered = (
        docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
        .repartitionByRange(F.col("key").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", F.col("text").asc_nulls_first())
    )
    return stored(ordered.mapInArrow(write, CHUNKS), "token-chunks")


def read_token_files(chunks: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all the documents before it: the chunks' sizes are summed in
    order within each shard, and the shards' sums before it, one number a task of the writer, added.
    """
    shards = sorted(map(tuple, chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("bytes").alias("bytes")).collect()))  # a row a task of the writer
    spark = chunks.sparkSession
    first = list(zip((shard for shard, _, _ in shards), accumulate((n for _, n, _ in shards), initial=0)))
    before_shard = spark.createDataFrame(first, "shard int, before_shard bigint")
    order = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_ids").over(order), F.lit(0))
    placed = chunks.withColumn("within", within).join(F.broadcast(before_shard), "shard").withColumn("before", F.col("before_shard") + F.col("within"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = opened(row["path"])
                with where.open_input_file(path) as source:
                    keys, lengths, ids = read_chunk(source.read_at(row["bytes"], row["offset"]))
                edges = np.concatenate(([0], np.cumsum(lengths)))
                plain = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(edges[:-1] + row["before"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )

    read_bytes = sum(size for _, _, size in shards)
    tasks = max(spark.sparkContext.defaultParallelism, -(-read_bytes // TASK_BYTES))  # small rows, much work
    spread = placed.select("path", "offset", "bytes", "before").repartition(tasks, "path", "offset")
    return spread.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(spark: SparkSession, docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", plain: bool = False) -> DataFrame:
    """Write the token files of a table to a fresh shared folder and read them back."""
    chunks = write_token_files(docs, fresh_folder(spark, "tokens"), vocabulary, key=key, text=text, plain=plain)
    return read_token_files(chunks).withColumnRenamed("key", key)
