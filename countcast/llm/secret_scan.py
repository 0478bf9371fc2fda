"""Secret scans: candidates from the text, false positives removed by a random forest.

1. One pass over all documents counts byte transitions and frequent words: tables of fixed size.
2. Every run of ``SHORTEST`` or more letters, digits and ``_+/=-`` is a candidate, and so is every
   quoted or assigned value after a name with a key word, of any length and alphabet. Findings that
   overlap are one. The features of a candidate are
   length, character classes and entropy, the mean log-probability of its transitions, the share
   of it that dictionary words cover, the path it stands in, and the words beside it.
3. A random forest learns from labelled findings. The tables of this engine hold none, so
   ``labelled_texts`` makes them by rule: random values of several alphabets under key names are
   secrets; the same values in paths and addresses, words and names under the same keys, and
   numbers are not. Candidates of a bounded sample of documents without any key beside them are
   negatives too. A table of labelled findings of one's own can be passed instead.
4. The forest's nodes go to the tasks as arrays, so one pass over the documents finds, judges and
   (for ``redact``) replaces; no text is shuffled.

Defined results: null and empty texts have no findings and stay as they are; repeated rows are
judged alike; a missing path is an empty one; an empty table gives no findings; other columns are
untouched. Offsets and lengths count characters.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.rows import mapped
from countcast.llm.words import Words, text_slices
from countcast.workspace import stored

#: Characters of the shortest candidate that no name stands before.
SHORTEST = 16
#: Words that occur at least once in so many are the dictionary, which therefore is no longer.
DICTIONARY = 20_000
#: Word forms that a task counts before it hands them on.
FORMS = 200_000
#: Documents (about) whose candidates join the training, and made findings.
SAMPLE_DOCS, MADE = 400, 4000
TREES, DEPTH = 30, 8
#: Score from which a candidate is a secret.
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Words that name a secret when they stand before it.
KEYS = ("api", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")

_CANDIDATE = re.compile(rb"[A-Za-z0-9_+/=\-]{%d,}" % SHORTEST)
#: A name, and the value that is assigned to it or stands behind it in quotes, on one line.
_VALUE = re.compile(
    rb"""(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)["'`\])]*+[ \t]*+"""
    rb"""(?:(?:=>|:=|==?|:)[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?"""
    rb"""(?:"((?:[^"\\\n]|\\[^\n])++)"|'((?:[^'\\\n]|\\[^\n])++)'|`([^`\n]++)`|["'`]?([^\s"'`]\S*+))"""
    rb"""|"((?:[^"\\\n]|\\[^\n])++)"|'((?:[^'\\\n]|\\[^\n])++)'|`([^`\n]++)`)"""
)
#: What closes an unquoted value and is not of it.
_CLOSING = b",;.\"'`"
_LETTERS = re.compile(rb"[a-z]+")
_SPACE = re.compile(rb"\s")
_KEYS = tuple(k.encode() for k in KEYS)
_NOT_WORD = re.compile(rb"[^a-z0-9]+")
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "entropy", "hexadecimal", "transitions", "coverage", "longest_letters",
    "in_path", "slashes", "test_path", "key_before", "assigned", "quoted", "whole_word",
)


@dataclass
class Corpus:
    """Log-probabilities of byte transitions, and the dictionary."""

    transitions: np.ndarray
    dictionary: frozenset[bytes]


def corpus_tables(docs: DataFrame, text: str = "text") -> Corpus:
    """Counted over all documents in one pass; at most 65,536 transitions and DICTIONARY words.

    Every word form counts, wherever it stands: a task hands its counts on as rows when it has
    FORMS of them, and the least frequency holds for the sums over all tasks.
    """

    def counted_words(words: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k.decode() for k in words], pa.string()), pa.array([-1] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())],
            names=["word", "pair", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = np.zeros(65536, np.int64), 0
        words: dict[bytes, int] = {}
        for batch in batches:
            for _, w in text_slices(batch, "text"):
                total += len(w.starts)
                if len(w.data) > 1:
                    pairs += np.bincount(w.data[:-1].astype(np.int32) * 256 + w.data[1:], minlength=65536)
                _, first, counts = np.unique(w.lower_hashes, return_index=True, return_counts=True)
                size = (w.ends - w.starts)[first]
                for i in np.flatnonzero((size >= 3) & (size < SHORTEST)):
                    word = w.data[w.starts[first[i]] : w.ends[first[i]]].tobytes().lower().strip(b".,;:!?")
                    if word.isalpha():
                        words[word] = words.get(word, 0) + int(counts[i])
                if len(words) >= FORMS:
                    yield counted_words(words)
                    words = {}
        yield counted_words(words)
        some = np.flatnonzero(pairs)
        names = ["words in all", *(None for _ in some)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([-1, *some.tolist()], pa.int32()), pa.array([total, *pairs[some].tolist()], pa.int64())],
            names=["word", "pair", "n"],
        )

    counted = stored(docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, pair int, n bigint").groupBy("word", "pair").agg(F.sum("n").alias("n")), "transitions")
    pairs = np.zeros(65536)
    for r in counted.where("pair >= 0").collect():
        pairs[r["pair"]] = r["n"]
    pairs = pairs.reshape(256, 256) + 0.1
    total = counted.where("word = 'words in all'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = counted.where((F.col("pair") < 0) & (F.col("n") >= max(3, total / DICTIONARY)) & (F.col("word") != "words in all"))
    return Corpus(np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(r["word"].encode() for r in frequent.select("word").collect()))


def coverage(letters: bytes, dictionary: frozenset[bytes]) -> int:
    """Most letters that dictionary words of three or more can cover without overlap."""
    best = [0] * (len(letters) + 1)
    for end in range(1, len(letters) + 1):
        best[end] = best[end - 1]
        for start in range(max(0, end - SHORTEST), end - 2):
            if best[start] + end - start > best[end] and letters[start:end] in dictionary:
                best[end] = best[start] + end - start
    return best[-1]


@dataclass
class Found:
    """Candidates of a slice: text, byte range, features."""

    text: list[int]
    start: list[int]
    end: list[int]
    rows: list[list[float]]


def features(value: bytes, before: bytes, word: bytes, offset: int, path: bytes, corpus: Corpus) -> list[float]:
    """``before``: the text in front, on the same line; ``word``: the run without white space that
    holds the value, at ``offset``."""
    n = len(value)
    data = np.frombuffer(value, np.uint8)
    counts = np.bincount(data, minlength=128)
    share = counts[counts > 0] / n
    digits, upper, lower = int(counts[48:58].sum()), int(counts[65:91].sum()), int(counts[97:123].sum())
    folded = value.lower()
    runs = _LETTERS.findall(folded)
    letters = sum(map(len, runs))
    covered = sum(coverage(r, corpus.dictionary) for r in runs if len(r) >= 3 and len(r) <= 256)
    ahead = word[:offset]
    near = before[-48:].lower()
    names = _NOT_WORD.split(near)[-4:]
    joined = near.rstrip(b"\"'` ")
    return [
        math.log(n), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n,
        float(-(share * np.log2(share)).sum()),
        float(digits + int(counts[97:103].sum()) == n or digits + int(counts[65:71].sum()) == n),
        float(corpus.transitions[data[:-1], data[1:]].mean()) if n > 1 else 0.0,
        covered / letters if letters else 0.0,
        max(map(len, runs), default=0) / n,
        float(b"/" in ahead or b"\\" in ahead or b"." in ahead), float(word.count(b"/")),
        float(any(x in path.lower() for x in (b"test", b"example", b"sample", b"mock"))),
        float(any(k.encode() in x for x in names for k in KEYS)),
        float(joined.endswith((b"=", b":", b"=>"))), float(ahead[-1:] in (b'"', b"'", b"`")),
        float(offset == 0 and n == len(word)),
    ]


def candidates(w: Words, paths: list[str | None], corpus: Corpus) -> Found:
    """All candidates of a slice with their features."""
    out = Found([], [], [], [])
    raw = None
    for i in np.flatnonzero(w.ends - w.starts >= SHORTEST):
        start, end = int(w.starts[i]), int(w.ends[i])
        raw = raw or w.data.tobytes()
        word = raw[start:end]
        t = int(w.text_of[i])
        for m in _CANDIDATE.finditer(word):
            at = start + m.start()
            line = max(raw.rfind(b"\n", int(w.edges[t]), at) + 1, int(w.edges[t]), at - 200)
            out.text.append(t)
            out.start.append(at)
            out.end.append(start + m.end())
            out.rows.append(features(m[0], raw[line:at], word, m.start(), (paths[t] or "").encode(), corpus))
    known = set(zip(out.start, out.end))
    raw = raw or w.data.tobytes()
    for t in range(w.texts):
        low, high = int(w.edges[t]), int(w.edges[t + 1])
        text = raw[low:high]
        for start, end in values(text):
            if (low + start, low + end) in known:
                continue
            begin = start
            while begin and text[begin - 1] not in b" \t\n\r\x0b\x0c" and start - begin < 200:
                begin -= 1
            line = max(text.rfind(b"\n", 0, start) + 1, start - 200)
            stop = _SPACE.search(text, end)
            out.text.append(t)
            out.start.append(low + start)
            out.end.append(low + end)
            row = features(text[start:end], text[line:start], text[begin : stop.start() if stop else len(text)], start - begin, (paths[t] or "").encode(), corpus)
            row[FEATURES.index("key_before")] = 1.0
            out.rows.append(row)
    return out


def values(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the values that names with a key word have in a text."""
    at = 0
    while m := _VALUE.search(text, at):
        at = m.end(1)  # a value may hold names itself
        name = m[1].lower()
        if not any(k in name for k in _KEYS):
            continue
        start, end = m.span(m.lastindex)
        if m.lastindex == 5:
            end = start + len(m[5].rstrip(_CLOSING))
            while end > start and text[end - 1 : end] in (b")", b"]", b"}") and _unopened(text[start:end]):
                end -= 1
        if end > start:
            yield start, end


def _unopened(value: bytes) -> bool:
    """Whether the bracket at the end closes none of the value."""
    close = value[-1:]
    return value.count(close) > value.count({b")": b"(", b"]": b"[", b"}": b"{"}[close])


def labelled_texts(count: int = MADE, seed: int = 3) -> list[tuple[str, str, int]]:
    """(text, path, label): findings made by rule, half of them secrets."""
    pick = random.Random(seed)
    hexa, base, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["the", "ing", "ion", "con", "per", "ver", "ter", "ent", "ist", "ment", "com", "est", "tra", "res", "ate", "for", "and", "all"]

    def value() -> str:
        alphabet = pick.choice((hexa, hexa.upper(), base, alnum))
        size = pick.choice((20, 24, 32, 36, 40, 48, 64))
        return "".join(pick.choice(alphabet) for _ in range(size)) + ("==" if alphabet is base and pick.random() < 0.3 else "")

    def wordy() -> str:
        return pick.choice(("", "_", "-")).join(pick.choice(syllables) for _ in range(pick.randint(6, 12)))

    out = []
    for k in range(count):
        name = pick.choice(("", "my_", "prod_", "aws_", "x-")) + pick.choice(KEYS) + pick.choice(("", "_id", "_value"))
        name = pick.choice((name, name.upper()))
        sign, quote = pick.choice((" = ", "=", ": ", " => ", " ")), pick.choice(('"', '"', "'", ""))
        lead = " ".join(wordy()[: pick.randint(2, 9)] for _ in range(pick.randint(0, 4)))
        if k % 2:
            out.append((f"{lead} {name}{sign}{quote}{value()}{quote} {lead}", pick.choice(("src/main", "conf/app.ini", "")), 1))
            continue
        kind = k // 2 % 6
        text = (
            f"{lead} {name}{sign}{quote}{wordy()}{quote}",
            f"{lead} https://example.org/{wordy()[:5]}/{value()}",
            f"{lead} objects/{value()[:2]}/{value()} {lead}",
            f"{lead} {wordy()} {lead}",
            f"{lead} {''.join(pick.choice('0123456789') for _ in range(pick.choice((16, 18, 22))))} {lead}",
            f"{lead} {name}{sign}{quote}{pick.choice(('x', '0', 'a', 'XXXX', 'your-key-'))*pick.choice((16, 20, 24))}{quote}",
        )[kind]
        out.append((text, pick.choice(("test/data", "src/main", "")), 0))
    return out + _labelled_values(count // 2, seed + 1)


def _labelled_values(count: int, seed: int) -> list[tuple[str, str, int]]:
    """(text, path, label): short values and values of any alphabet under key names, half of them
    secrets."""
    pick = random.Random(seed)
    letters, digits, signs = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*?~+-_."
    nouns = ["value", "name", "user", "default", "required", "string", "field", "public", "optional", "enabled", "length", "primary", "server", "config", "index", "count", "the", "and", "with", "for"]

    def mixed_up(word: str) -> str:
        """As people make passwords: capitals, digits and signs within and after a word."""
        swapped = "".join({"o": "0", "e": "3", "a": "4", "i": "1", "s": "$"}.get(c, c) if pick.random() < 0.5 else c for c in word)
        return swapped[0].upper() + swapped[1:] + "".join(pick.choice(digits + signs[:4]) for _ in range(pick.randint(1, 4)))

    out = []
    for k in range(count):
        name = pick.choice(("", "my_", "db_", "x-", "DB_")) + pick.choice(KEYS) + pick.choice(("", "_value", "2"))
        sign, quote = pick.choice((" = ", "=", ": ", " => ", ":")), pick.choice(('"', "'", ""))
        lead = " ".join(pick.choice(nouns) for _ in range(pick.randint(0, 5)))
        if k % 2:
            size = pick.randint(7, 24)
            value = (
                "".join(pick.choice(letters + letters.upper() + digits + signs) for _ in range(size)),
                "".join(pick.choice(letters + letters.upper() + digits) for _ in range(size)),
                mixed_up("".join(pick.choice(letters) for _ in range(pick.randint(6, 12)))),
                mixed_up(pick.choice(nouns) + pick.choice(nouns)),
            )[k // 2 % 4]
        else:
            value = (
                pick.choice(nouns),
                " ".join(pick.choice(nouns) for _ in range(pick.randint(2, 6))) if quote else pick.choice(nouns),
                str(pick.choice((0, 1, 5, 42, 3306, 8080, 2024, 65536, pick.randint(0, 99999)))),
                pick.choice(("true", "false", "null", "None", "undefined", "****", "xxxxxxxx", "...", "[SECRET]", "''", "0.75", "1e-5")),
                pick.choice(("${%s}", "$%s", "<%s>", "{{ %s }}", "os.environ.%s", "get_%s()", "self.%s", "{%s}", "%%(%s)s", "your-%s-here")) % (pick.choice(nouns) + pick.choice(("", "_id"))),
                pick.choice(("_", "-", ".", "/")).join(pick.choice(nouns) for _ in range(pick.randint(2, 4))),
            )[k // 2 % 6]
        out.append((f"{lead} {name}{sign}{quote}{value}{quote}{pick.choice(('', ',', ';', ''))} {lead}", pick.choice(("src/main", "conf/app.ini", "")), k % 2))
    return out


def _featured(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """(features, label) of the candidates of (text, path, label); a null label marks negatives
    only where no key stands before the candidate."""
    key = FEATURES.index("key_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                found = candidates(w, part.column("path").to_pylist(), corpus)
                labels = part.column("label").to_pylist()
                kept = [(r, labels[t] or 0) for t, r in zip(found.text, found.rows) if labels[t] is not None or not r[key]]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.list_(pa.float64())), pa.array([x for _, x in kept], pa.int32())], names=["features", "label"])

    return rows.mapInArrow(run, "features array<double>, label int")


@dataclass
class Forest:
    """Nodes of all trees end to end; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of secrets in the row's leaf."""
        total = np.zeros(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                low = rows[np.arange(len(rows)), self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total / len(self.roots)


def _exported(model) -> Forest:
    """The nodes of a fitted forest: bounded by TREES and DEPTH, whatever the training rows."""
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        stats = [node.impurityStats().stats()[i] for i in range(2)]
        for column, x in ((feature, 0), (threshold, 0.0), (left, at), (right, at), (value, stats[1] / max(1e-12, sum(stats)))):
            column.append(x)
        if node.subtreeDepth() > 0:
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at] = add(node.leftChild())
            right[at] = add(node.rightChild())
        return at

    for tree in model._java_obj.trees():
        roots.append(add(tree.rootNode()))
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def fit(docs: DataFrame, corpus: Corpus, labelled: DataFrame | None = None, path: str = "source", text: str = "text") -> Forest:
    """A forest from labelled findings (text, path, label), made ones where none are given."""
    spark: SparkSession = docs.sparkSession
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("label", T.IntegerType())])
    given = labelled.select("text", "path", "label") if labelled is not None else spark.createDataFrame(labelled_texts(), schema)
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    own = docs.select(F.col(text).alias("text"), where.alias("path"), F.lit(None).cast("int").alias("label")).sample(fraction=share, seed=13)
    rows = stored(_featured(given.unionByName(own), corpus), "findings")
    vectors = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return _exported(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, subsamplingRate=0.8).fit(vectors))


def _char_places(w: Words) -> np.ndarray:
    """Characters before each byte of the slice."""
    return np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))


def _judged(w: Words, paths: list[str | None], corpus: Corpus, forest: Forest, threshold: float) -> tuple[Found, np.ndarray, np.ndarray]:
    """Findings in order, those that overlap as one with the highest score."""
    found = candidates(w, paths, corpus)
    scores = forest.score(np.array(found.rows)) if found.rows else np.empty(0)
    out, best = Found([], [], [], []), []
    for i in sorted(np.flatnonzero(scores >= threshold).tolist(), key=lambda i: (found.start[i], found.end[i])):
        if out.text and found.start[i] < out.end[-1]:
            out.end[-1] = max(out.end[-1], found.end[i])
            best[-1] = max(best[-1], scores[i])
            continue
        out.text.append(found.text[i])
        out.start.append(found.start[i])
        out.end.append(found.end[i])
        best.append(scores[i])
    return out, np.array(best), np.arange(len(best))


def trained(docs: DataFrame, path: str = "source", text: str = "text", labelled: DataFrame | None = None) -> tuple[Corpus, Forest]:
    corpus = corpus_tables(docs, text)
    return corpus, fit(docs, corpus, labelled, path, text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, score) of every secret in every document."""
    corpus, forest = trained(docs, path, text, labelled)
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in text_slices(batch, "text"):
                found, scores, secret = _judged(w, part.column("path").to_pylist(), corpus, forest, threshold)
                if len(secret):
                    places = _char_places(w)
                    t = np.array(found.text)[secret]
                    start, end = places[np.array(found.start)[secret]], places[np.array(found.end)[secret]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(t)), pa.array(start - places[w.edges[t]], pa.int64()), pa.array(end - start, pa.int64()), pa.array(scores[secret])],
                        names=["doc_id", "start", "length", "score"],
                    )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), where.alias("path"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, score double")


def redact(docs: DataFrame, text: str = "text", path: str = "source", mask: str = MASK, threshold: float = THRESHOLD, labelled: DataFrame | None = None, chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with each secret in the text replaced; ``chars``, if the table has
    it, becomes the new length of a changed text."""
    corpus, forest = trained(docs, path, text, labelled)
    schema, masked = docs.schema, mask.encode()
    counted = chars if chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in text_slices(batch, text):
                paths = part.column(path).cast(pa.string()).to_pylist() if path in part.schema.names else [None] * part.num_rows
                found, _, secret = _judged(w, paths, corpus, forest, threshold)
                if len(secret):
                    texts = part.column(text).to_pylist()
                    sizes = part.column(counted).to_pylist() if counted else None
                    raw = w.data.tobytes()
                    spans: dict[int, list[tuple[int, int]]] = {}
                    for k in secret:
                        spans.setdefault(found.text[k], []).append((found.start[k], found.end[k]))
                    for t, cuts in spans.items():
                        at, pieces = int(w.edges[t]), []
                        for start, end in cuts:
                            pieces += [raw[at:start], masked]
                            at = end
                        texts[t] = b"".join([*pieces, raw[at : int(w.edges[t + 1])]]).decode()
                        if counted:
                            sizes[t] = len(texts[t])
                    new = {text: pa.array(texts, part.schema.field(text).type)}
                    if counted:
                        new[counted] = pa.array(sizes, part.schema.field(counted).type)
                    part = pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(part.schema.names, part.columns)], names=part.schema.names)
                yield part

    return mapped(docs, run, schema)
