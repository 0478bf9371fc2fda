"""Similarity join on word 5-grams: T-occurrence search by DivideSkip, spread over tasks.

Two documents link when their sets of distinct 5-word shingles (A-Z lowered; a shorter text is
one shingle) have a Jaccard similarity of 0.75 or more. Documents with equal sets are one node.

A document of n shingles can only link with another if they share T >= 0.75 n of them. DivideSkip
sets L < T lists aside, so they meet in T - L of the n - L others, in any order of the shingles
that is the same for all. Here the order is by hash, with the shingles that very many documents
hold last: those are the long lists, which nobody merges who can do without.

1. The first n - L shingles of each document make the inverted lists. The documents of a list go
   to the list's hub (its smallest node) if the list is one of their first n - T + 1: the first
   shingle that two linked documents share is early in both. A hub's documents are dealt to blocks of bounded size,
   and each two blocks of a hub are a task. It merges its short lists with a heap that skips what
   cannot reach T - L; documents without a partner there leave the task.
2. The texts of those that are left come to their tasks, where DivideSkip runs on the whole
   sets: short lists are merged, the L longest probed by binary search, and documents that reach
   the overlap are linked, unless the task's links so far connect them anyway.

So each pair that shares enough first shingles is compared in a task or is connected already
there: the components are exact. Rows (shingle, node), and the texts once, are shuffled; no task
holds more than two blocks. Crowds of documents that share lists without being similar cost a
task for each two blocks: the pairs are counted in the tasks and never become rows.

Defined results: null and empty texts have no shingles and are linked with nothing; component_id
is the smallest doc_id of the component, itself where there is no link (null keys are larger than
all, and null if all are); rows equal in text are linked; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.llm.components import components
from countcast.llm.rows import with_row_ids
from countcast.llm.words import Words, buffer_of, mixed, text_slices
from countcast.workspace import stored

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents of a block (on average).
BLOCK = 512
#: A shingle of more documents than this is ordered last and its list is dealt in parts of so many.
LONG = 512
#: The share of each document's first shingles in which frequent ones are looked for.
COUNTED = 0.25
#: At most so many shingles are ordered last: the most frequent ones. A bound on what is sent to
#: the tasks; the order decides the work and never the result.
LAST = 1 << 20
#: Entries of short lists up to which a heap merges them: beyond, numpy counts them sooner (20 against
#: 270 microseconds a merge in the groups of the given documents).
HEAPED = 32
#: Long lists that are probed at once, before documents that cannot reach the overlap are left out.
PROBED = 16
_ROW = "__row_of_table__"
#: DivideSkip's weight of probing against merging.
MU = 0.01


def needed(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set it links with."""
    return -(-PERCENT * n // 100)


def least_short(n: int) -> int:
    """T - L of a set of ``n``: short lists in which a partner must be found (DivideSkip's choice
    of L for lists of up to LONG documents)."""
    least = needed(n)
    return max(1, least - int(least / (MU * math.log2(LONG) + 1)))


def _least_short(n: Column) -> Column:
    """The same of a column."""
    least = F.floor((PERCENT * n + 99) / 100)
    return F.greatest(F.lit(1), least - F.floor(least / F.lit(MU * math.log2(LONG) + 1)))


def overlap(a: int, b: int) -> int:
    """Shingles that sets of these sizes share at least if they link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the sorted distinct shingles of each text, end to end."""
    words = w.lower_hashes
    at, h = w.windows(words, SHINGLE)
    text = w.text_of[at] if len(at) else at
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):  # the whole sequence, told from the others by its length
        whole = w.counts[short].astype(np.uint64)
        for i in range(SHINGLE - 1):
            has = w.counts[short] > i
            whole[has] = mixed(whole[has] * np.uint64(0xD6E8FEB86659FD93) + words[w.first[short[has]] + i])
        h, text = np.concatenate((h, whole)), np.concatenate((text, short))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
    h, text = h[new], text[new]
    return np.searchsorted(text, np.arange(w.texts + 1)), h


def node_of(shingles: np.ndarray) -> int:
    """The node of a set: a signed 64-bit digest."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def nodes_of_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, node) of each row; an empty set has no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                edges, h = shingle_sets(w)
                nodes = [node_of(h[a:b]) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(np.diff(edges), pa.int64()), pa.array(nodes, pa.int64())],
                    names=["row", "doc_id", "n_shingles", "node"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, n_shingles bigint, node bigint")


def _postings(docs: DataFrame, last: np.ndarray, parts: np.ndarray, share: float) -> DataFrame:
    """(shingle, part, node, n) of the first shingles of each document; ``n`` is twice the size of its
    set, and one more where the shingle is early: the first one that a linked pair shares is early in both.

    ``last``: sorted shingles that come after all others, ``parts``: in how many parts their
    lists are dealt. ``share`` makes the lists shorter for counting only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                edges, h = shingle_sets(w)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own, n = h[a:b], b - a
                    if not n or (node := node_of(own)) in seen:
                        continue
                    if len(seen) < 500_000:  # fewer repeated rows; they are told apart later anyway
                        seen.add(node)
                    own = own.view(np.int64)
                    at = np.searchsorted(last, own) if len(last) else np.zeros(n, np.int64)
                    is_last = last[np.minimum(at, len(last) - 1)] == own if len(last) else np.zeros(n, bool)
                    size = max(1, math.ceil(share * (n - needed(n) + least_short(n))))
                    first = np.concatenate((np.flatnonzero(~is_last), np.flatnonzero(is_last)))[:size]
                    dealt = np.zeros(len(first), np.int64)
                    hot = is_last[first]
                    if hot.any():
                        salt = mixed(own[first[hot]].view(np.uint64) ^ np.uint64(node & (1 << 64) - 1))
                        dealt[hot] = 1 + salt % parts[at[first[hot]]].astype(np.uint64)
                    early = np.arange(len(first)) <= n - needed(n)
                    out.append((own[first], dealt, np.full(len(first), node), 2 * n + early))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2], pa.int64()), pa.array(columns[3].astype(np.int32))], names=["shingle", "part", "node", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, part int, node bigint, n int")


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, parts): those that more than LONG documents have among their first ones."""
    none = np.empty(0, np.int64)
    counts = _postings(docs, none, none, COUNTED).groupBy("shingle").count().where(F.col("count") > LONG * COUNTED)
    top = counts.orderBy(F.desc("count"), "shingle").limit(LAST).toPandas()
    order = np.argsort(top["shingle"].to_numpy())
    return top["shingle"].to_numpy()[order], 1 + (top["count"].to_numpy()[order] / COUNTED).astype(np.int64) // LONG


def shared_lists(postings: DataFrame) -> DataFrame:
    """(shingle, node, n, early, hub) of the lists of two documents or more.

    Lists, or their parts, arrive sorted and are read as a stream. The smallest node of a list is
    its hub, of one in parts the smallest of the parts' hubs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last row, whose list may go on: shingle, part, node, n, hub
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if not len(rows[0]):
                continue
            if held:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows)]
            shingle, part, node, n = rows
            same_list = np.append(False, (shingle[1:] == shingle[:-1]) & (part[1:] == part[:-1]))
            again = np.append(False, same_list[1:] & (node[1:] == node[:-1]))
            begins = np.flatnonzero(~same_list)
            hub = np.repeat(node[begins], np.diff(np.append(begins, len(node))))
            if held:
                hub[: begins[1] if len(begins) > 1 else None] = held[4][0]
            send = same_list & ~again
            send[begins[np.logical_or.reduceat(send, begins)]] = True
            send |= (part > 0) & ~again  # a part of a list: the others are elsewhere
            if held and (part[0] > 0 or held[4][0] != held[2][0]):
                send[0] = False  # it was sent with the batch before
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[send]), pa.array(part[send].astype(np.int32)), pa.array(node[send]), pa.array(n[send].astype(np.int32)), pa.array(hub[send])],
                names=["shingle", "part", "node", "n", "hub"],
            )
            held = [shingle[-1:], part[-1:], node[-1:], n[-1:], hub[-1:]]

    by_list = postings.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "node")
    lists = stored(by_list.mapInArrow(run, "shingle bigint, part int, node bigint, n int, hub bigint"), "lists")
    tops = lists.where("part > 0").groupBy("shingle").agg(F.min("hub").alias("top"))
    sizes = F.shiftright("n", 1).alias("n"), (F.col("n") % 2 == 1).alias("early")
    return lists.join(tops, "shingle", "left").select("shingle", "node", *sizes, F.coalesce("top", "hub").alias("hub"))


def t_occurrence(lists: list[list[int]], least: int, low: int, long: int) -> Iterator[tuple[int, int]]:
    """MergeSkip: (element, count) for elements >= ``low`` in at least ``least - long`` of the
    lists but the ``long`` longest. Lists are sorted, and come shortest first."""
    want = least - long
    short = lists[: len(lists) - long]
    heap = []
    place = []
    for i, elements in enumerate(short):
        at = bisect_left(elements, low) if low else 0
        place.append(at)
        if at < len(elements):
            heap.append((elements[at], i))
    heapq.heapify(heap)
    while len(heap) >= want:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= want:
            yield top, len(popped)
            for i in popped:
                place[i] += 1
                if place[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][place[i]], i))
            continue
        while heap and len(popped) < want - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            return
        target = heap[0][0]
        for i in popped:
            place[i] = bisect_left(short[i], target, place[i])
            if place[i] < len(short[i]):
                heapq.heappush(heap, (short[i][place[i]], i))


class Lists:
    """Inverted lists of some documents' sets, the documents in ascending order of size."""

    def __init__(self, sets: list[list[int]]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)))
        _, which = np.unique(np.concatenate([np.array(s, np.int64) for s in sets]), return_inverse=True)
        order = np.argsort(which, kind="stable")
        #: Documents of all lists, list by list, ascending within each.
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[order]
        begins = np.concatenate(([0], np.cumsum(np.bincount(which))))
        self.begin = begins[which]
        #: List and document of each place, as one ascending number.
        self.keys = which[order] * len(sets) + self.docs
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def before(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in ``docs`` of x's lists as far as they hold earlier documents, the
        shortest first; empty ones are left out."""
        own = slice(self.edges[x], self.edges[x + 1])
        begin, end = self.begin[own], self.place[own]
        some = np.flatnonzero(end > begin)
        some = some[np.argsort((end - begin)[some], kind="stable")]
        return begin[some], end[some]

    def probed(self, begin: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """In how many of the lists at ``begin`` each of the documents is, by binary search."""
        wanted = (self.keys[begin] - self.docs[begin])[:, None] + docs
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted).sum(axis=0)

    def meeting(self, begin: np.ndarray, end: np.ndarray, least: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents >= low in ``least`` of these lists or more, in how many), ascending.

        A heap merges the lists, skipping what cannot reach ``least``. Where the lists hold more
        than HEAPED entries, most of them have to be popped, and they are counted at once.
        """
        if len(begin) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = end - begin
        if lengths.sum() <= HEAPED:
            found = list(t_occurrence([self.docs[a:b].tolist() for a, b in zip(begin, end)], least, low, 0))
            return np.array([y for y, _ in found], np.int64), np.array([c for _, c in found], np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = np.bincount(self.docs[np.repeat(begin - starts, lengths) + np.arange(lengths.sum())])
        counts[:low] = 0
        docs = np.flatnonzero(counts >= least)
        return docs, counts[docs]


def block_links(sets: list[list[int]]) -> list[tuple[int, int]]:
    """Links that connect what the similarity connects among these sets (a spanning forest)."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    if not order:
        return []
    lists = Lists([sets[i] for i in order])
    sizes = lists.sizes
    component = np.arange(len(order))
    links = []
    for x in range(1, len(order)):
        n = int(sizes[x])
        least = needed(n)
        low = int(np.searchsorted(sizes, least))
        begin, end = lists.before(x)
        if low >= x or len(begin) < least:
            continue
        longest = int(end[-1] - begin[-1])
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)), len(begin))
        short = len(begin) - long
        docs, counts = lists.meeting(begin[:short], end[:short], least - long, low)
        want = -(-PERCENT * (n + sizes[docs]) // (100 + PERCENT))
        for at in range(short, len(begin), PROBED):  # binary probes
            able = counts + (len(begin) - at) >= want
            if not able.all():
                docs, counts, want = docs[able], counts[able], want[able]
            if not len(docs) or (counts >= want).all():
                break
            counts = counts + lists.probed(begin[at : at + PROBED], docs)
        for y in docs[counts >= want].tolist():
            if component[y] != component[x]:
                links.append((order[y], order[x]))
                component[component == component[y]] = component[x]
    return links


def partners(nodes: list[int], sizes: list[int], shingles: list[np.ndarray], hubs: list[np.ndarray], early: list[np.ndarray], hub: int) -> set[int]:
    """Places of the documents of a block that meet another in enough short lists.

    A pair counts in the block of the hub of the first list that is early in both only, not in every
    block that both are in. ``shingles`` are in the order of the lists.
    """
    order = sorted(range(len(nodes)), key=lambda i: (sizes[i], nodes[i]))
    ordered = [sizes[i] for i in order]
    lists = Lists([shingles[i] for i in order])
    enough = np.array([least_short(n) for n in ordered])
    firsts: dict[int, dict[int, int]] = {}  # the hubs of a document's early lists, in their order

    def early_hubs(x: int) -> dict[int, int]:
        if x not in firsts:
            own = np.asarray(early[order[x]], bool)
            firsts[x] = dict(zip(np.asarray(shingles[order[x]])[own].tolist(), np.asarray(hubs[order[x]])[own].tolist()))
        return firsts[x]

    found = np.zeros(len(order), bool)
    for x in range(1, len(order)):
        low = bisect_left(ordered, needed(ordered[x]))
        if low >= x:
            continue
        begin, end = lists.before(x)
        docs, counts = lists.meeting(begin, end, least_short(needed(ordered[x])), low)
        for y in docs[counts >= enough[docs]].tolist():
            if found[x] and found[y]:
                continue
            of_y = early_hubs(y)
            if next((h for s, h in early_hubs(x).items() if s in of_y), None) == hub:
                found[x] = found[y] = True
    return {order[x] for x in np.flatnonzero(found)}


def _dealt(members: DataFrame) -> DataFrame:
    """(hub, block, other, node): the nodes of a hub in blocks, each block with each other one.

    A hub of one block is a task by itself (block 0 with 0).
    """
    sizes = members.groupBy("hub").agg((1 + F.floor(F.count("*") / BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("hub", "node"), "blocks").cast("int")
    placed = members.join(sizes, "hub").select("hub", "node", "blocks", own.alias("own"))
    with_others = placed.select("hub", "node", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("second")).where("blocks = 1 or own <> second")
    return with_others.select("hub", F.least("own", "second").alias("block"), F.greatest("own", "second").alias("other"), "node")


def _with_partners(dealt: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of blocks whose document meets another of the block in enough short lists."""
    listed = F.array_sort(F.collect_list(F.struct("shingle", "hub", "early")))
    own = lists.groupBy("node").agg(F.first("n").alias("n"), listed.alias("listed"))
    own = own.select("node", "n", F.col("listed.shingle").alias("shingles"), F.col("listed.hub").alias("hubs"), F.col("listed.early").alias("early"))

    def run(key, group):
        hub, block, other = (int(k) for k in key)
        nodes = group["node"].tolist()
        lists = (group[c].tolist() for c in ("shingles", "hubs", "early"))
        left = sorted(partners(nodes, group["n"].tolist(), *lists, hub))
        return pd.DataFrame({"hub": hub, "block": block, "other": other, "node": [nodes[i] for i in left]})

    return dealt.join(own, "node").groupBy("hub", "block", "other").applyInPandas(run, "hub bigint, block int, other int, node bigint")


def _links_in_blocks(dealt: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) within blocks of (hub, block, node), on the whole texts."""
    rows = nodes.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
    placed = dealt.join(rows, "node").join(docs.select("row", "text"), "row")

    def run(group):
        w = Words(*buffer_of(pa.array(group["text"], pa.large_string())))
        edges, h = shingle_sets(w)
        _, ids = np.unique(h, return_inverse=True)  # small numbers in place of hashes
        sets = [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
        nodes = group["node"].to_numpy()
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in block_links(sets)], columns=["a", "b"])

    return placed.select("hub", "block", "other", "node", "text").groupBy("hub", "block", "other").applyInPandas(run, "a bigint, b bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, root, component_id) of every row of a table.

    ``row`` is a unique bigint column of the table, else a key of the row's place is made.
    ``root`` is the node that names the component; it is null without shingles.
    """
    columns = [F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    docs = docs.select(F.col(row).alias("row"), *columns) if row else with_row_ids(docs.select(*columns), "row")
    nodes = stored(nodes_of_rows(docs), "nodes")
    last, parts = frequent(docs)
    lists = shared_lists(_postings(docs, last, parts, 1.0))
    meets = lists.groupBy("node", "n").count().where(F.col("count") >= _least_short(F.col("n")))
    lists = stored(lists.join(meets.select("node"), "node", "left_semi"), "lists")
    blocks = stored(_with_partners(_dealt(lists.where("early").select("hub", "node").distinct()), lists), "blocks")
    labels = stored(components(_links_in_blocks(blocks, docs, nodes)), "labels")
    least = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = least.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "root", "component_id")
    out = nodes.join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", "n_shingles", "root", own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with its smallest doc_id (of several, the first by place).

    Rows without shingles all stay. Columns and texts are unchanged.
    """
    placed = with_row_ids(docs, _ROW)
    found = stored(join(placed, row=_ROW), "components")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    best = found.where("root is not null").groupBy("root").agg(F.min(first).alias("first"))
    kept = best.select(F.col("first.row").alias(_ROW)).union(found.where("root is null").select("row"))
    return placed.join(kept, _ROW, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
