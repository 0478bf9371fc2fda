"""Clusters around centroids, searched through a vector approximation file (VA-file).

Vectors of integers are kept in blocks: a file with the full vectors, row after row, and a table
row with their cells, ``bits`` of each dimension, kept in a byte. For a set of centroids,
lookup tables give the least and the greatest squared distance that each cell leaves open to
each centroid; their sums are an interval for every (vector, centroid). A vector one of whose
intervals ends below the beginnings of all others is assigned without being read. Of
the others, the full vectors are fetched from the block's file, and exact integer distances to the
centroids whose intervals overlap decide; ties go to the smaller number. A round of updates
needs the full vectors of those only that change their cluster, as sums move by differences.

The driver holds the borders of the cells, the centroids and one row of sums for each centroid:
as large as ``clusters`` times the dimensions, whatever the number of vectors. Blocks are of
bounded size, lie in the folder of ``spark.checkpoint.dir``, and count once the row that names
them is committed; a lost executor repeats its blocks of one round. Cells are of equal width
over SPREAD standard deviations around the mean of a dimension, the outer ones reach to its least
and greatest value; they decide how much is read, never a result.

Defined results: vectors that are null, of another length or with a null, NaN or infinite component
are left out; a component beyond ±LARGEST after scaling counts as that bound, so that
distances of up to 100 dimensions fit 64 bits; repeated rows are clustered each by itself; a null key sorts like an
empty one among the starts; equal starts are ordered by their vectors; with fewer vectors than
clusters every vector is a start; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.llm.files import fresh_folder, fresh_name, opened
from countcast.workspace import stored

#: Vectors in a block.
BLOCK = 16_384
#: Bits of a cell, at most 8. Where the two nearest centroids are almost equally far, wide cells
#: leave nearly every interval open.
BITS = 8
#: Standard deviations to both sides of the mean that the cells cover.
SPREAD = 4.5
#: Vectors whose intervals are added up at once.
ROWS = 1024
#: Components are whole numbers up to this size.
LARGEST = 1 << 27
#: Bytes of vectors that are not needed, but read rather than skipped between two that are.
GAP = 1 << 16


@dataclass(frozen=True)
class VaFile:
    """Blocks as rows (block, file, n, keys, cells), and the borders of the cells."""

    blocks: DataFrame
    borders: np.ndarray  # dims x (cells + 1): cell c holds borders[c] <= x < borders[c + 1]

    @property
    def dims(self) -> int:
        return len(self.borders)

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession


def usable(vector: Column, dims: int) -> Column:
    """Vectors of that length whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & F.coalesce(finite, F.lit(False))


def _borders(vectors: DataFrame, dims: int, scale: float, bits: int) -> np.ndarray:
    """Borders of the cells of each dimension, as whole numbers. One row for each dimension."""
    x = F.col("x")
    found = (
        vectors.select(F.posexplode("vector").alias("dim", "x"))
        .groupBy("dim").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
        .collect()
    )
    out = np.zeros((dims, (1 << bits) + 1), np.int64)
    for row in found:
        inner = np.linspace(-SPREAD, SPREAD, (1 << bits) - 1)
        cuts = np.clip(np.nan_to_num(row["mean"] + row["sd"] * inner), row["low"], row["high"])
        out[row["dim"]] = _whole(np.array([row["low"], *cuts, row["high"]]), scale)
    out[:, -1] += 1
    return out


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64)


def _cells(v: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The cell of each component, a byte each."""
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(borders[d, 1:-1], v[:, d], side="right")
    return out


def build(vectors: DataFrame, key: str, vector: str, dims: int, scale: float = 1.0, bits: int = BITS) -> VaFile:
    """Blocks of the usable vectors, each component x as ``floor(scale * x)``."""
    spark = vectors.sparkSession
    as_array = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{key}`").cast("bigint").alias("key"), as_array.alias("vector")).where(usable(F.col("vector"), dims))
    borders = _borders(kept, dims, scale, bits)
    folder = fresh_folder(spark, "vectors")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(keys: pa.Array, v: np.ndarray) -> pa.RecordBatch:
            uri = fresh_name(folder, ".vectors")
            system, path = opened(uri)
            with system.open_output_stream(path) as out:
                out.write(v.astype("<i4").tobytes())
            columns = [pa.array([uri]), pa.array([len(v)]), pa.ListArray.from_arrays([0, len(v)], keys), pa.array([_cells(v, borders).tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["file", "n", "keys", "cells"])

        waiting, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                waiting.append((part.column("key"), _whole(flat.reshape(part.num_rows, dims), scale)))
                n += part.num_rows
                if n >= BLOCK:
                    yield block(pa.concat_arrays([k for k, _ in waiting]), np.concatenate([v for _, v in waiting]))
                    waiting, n = [], 0
        if n:
            yield block(pa.concat_arrays([k for k, _ in waiting]), np.concatenate([v for _, v in waiting]))

    blocks = kept.mapInArrow(write, "file string, n bigint, keys array<bigint>, cells binary")
    return VaFile(stored(blocks, "blocks"), borders)


def fetch(file, rows: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of ``rows`` (ascending) from an open block file; near ones are read together."""
    width = 4 * dims
    out = np.empty((len(rows), dims), np.int64)
    if not len(rows):
        return out
    cuts = np.flatnonzero(np.diff(rows) * width > GAP) + 1
    for part in np.split(np.arange(len(rows)), cuts):
        low, high = int(rows[part[0]]), int(rows[part[-1]]) + 1
        file.seek(low * width)
        read = np.frombuffer(file.read((high - low) * width), "<i4").reshape(-1, dims)
        out[part] = read[rows[part] - low]
    return out


def bound_tables(borders: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Least, then greatest, squared distance of each cell to each centroid: dims x cells x (2 * centroids)."""
    low, high = borders[:, :-1, None], borders[:, 1:, None] - 1
    c = centroids.T[:, None, :]
    least = np.maximum(np.maximum(low - c, c - high), 0)
    greatest = np.maximum(np.abs(c - low), np.abs(high - c))
    return np.concatenate((least, greatest), axis=2) ** 2


def intervals(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The tables' rows of each vector's cells, added up."""
    out = np.zeros((len(cells), tables.shape[2]), np.int64)
    for at in range(0, len(cells), ROWS):
        part, total = cells[at : at + ROWS], out[at : at + ROWS]
        for d, table in enumerate(tables):
            total += table[part[:, d]]
    return out


def nearest_in_block(cells: np.ndarray, tables: np.ndarray, centroids: np.ndarray, file) -> tuple[np.ndarray, int]:
    """(nearest centroid of each vector, number of vectors fetched)."""
    n = len(cells)
    bounds = intervals(cells, tables)
    least, greatest = bounds[:, : len(centroids)], bounds[:, len(centroids) :]
    best = greatest.argmin(axis=1)
    open_pairs = least <= greatest[np.arange(n), best][:, None]
    rows = np.flatnonzero(open_pairs.sum(axis=1) > 1)
    if len(rows):
        v = fetch(file, rows, centroids.shape[1])
        row, centroid = np.nonzero(open_pairs[rows])
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        for at in range(0, len(row), BLOCK):
            r, c = row[at : at + BLOCK], centroid[at : at + BLOCK]
            exact[r, c] = ((v[r] - centroids[c]) ** 2).sum(axis=1)
        best[rows] = exact.argmin(axis=1)  # the first of equal ones
    return best, len(rows)


def _assigned(va: VaFile, blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of blocks with the new ``clusters``, and of (cluster, moved, s0, s1, ...) sums of
    vectors that came to a cluster less those that left it."""
    borders, dims, k = va.borders, va.dims, len(centroids)
    sums = [f"s{d}" for d in range(dims)]
    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("clusters", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("fetched", "cluster", "moved", *sums)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bound_tables(borders, centroids)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        arrow = pa.schema([(f.name, pa.binary() if f.name in ("cells", "clusters") else pa.string() if f.name == "file" else pa.int64()) for f in schema.fields])
        for batch in batches:
            for uri, n, packed, before in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "cells", "clusters"))):
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    now, fetched = nearest_in_block(np.frombuffer(packed, np.uint8).reshape(n, dims), tables, centroids, file)
                    old = np.frombuffer(before, "<i4") if before else np.full(n, -1, np.int32)
                    rows = np.flatnonzero(now != old)
                    v = fetch(file, rows, dims)
                np.add.at(total, now[rows], v)
                np.add.at(count, now[rows], 1)
                left = old[rows] >= 0
                np.subtract.at(total, old[rows][left], v[left])
                np.subtract.at(count, old[rows][left], 1)
                row = {"file": [uri], "n": [n], "cells": [packed], "clusters": [now.astype("<i4").tobytes()], "fetched": [fetched]}
                yield pa.RecordBatch.from_pydict({f.name: row.get(f.name, [None]) for f in schema.fields}, schema=arrow)
        changed = np.flatnonzero((total != 0).any(axis=1) | (count != 0))
        if len(changed):
            row = {"cluster": changed, "moved": count[changed], **{s: total[changed, d] for d, s in enumerate(sums)}}
            yield pa.RecordBatch.from_pydict({f.name: row.get(f.name, [None] * len(changed)) for f in schema.fields}, schema=arrow)

    return stored(blocks.select("file", "n", "cells", "clusters").mapInArrow(run, schema), "assigned")


def starts(vectors: DataFrame, clusters: int, salt: str, scale: float) -> np.ndarray:
    """The vectors whose salted keys have the smallest hashes, in their order: ``clusters`` rows at most."""
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(clusters).collect()
    return _whole(np.array([r["vector"] for r in rows], np.float64), scale)


@dataclass(frozen=True)
class Clustering:
    """The final assignment and its centroids."""

    va: VaFile
    blocks: DataFrame
    centroids: np.ndarray
    fetched: list[int]  # vectors read in each round because intervals overlapped

    def members(self) -> DataFrame:
        """(key, cluster, distance): the exact squared distance of every vector to its centroid."""
        dims, centroids = self.va.dims, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri, n, keys, clusters in zip(batch.column("file").to_pylist(), batch.column("n").to_pylist(), batch.column("keys"), batch.column("clusters").to_pylist()):
                    system, path = opened(uri)
                    own = np.frombuffer(clusters, "<i4")
                    with system.open_input_file(path) as file:
                        v = fetch(file, np.arange(n), dims)
                    distance = ((v - centroids[own]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([keys.values, pa.array(own), pa.array(distance)], names=["key", "cluster", "distance"])

        rows = self.va.blocks.select("file", "n", "keys").join(self.blocks.select("file", "clusters"), "file")
        return rows.mapInArrow(run, "key bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, clusters: int, rounds: int, key: str, vector: str, dims: int, scale: float = 1.0, salt: str = "", bits: int = BITS) -> Clustering | None:
    """``rounds`` rounds of assigning and of moving each centroid to the floor of its members' mean,
    then a last assignment. None without a usable vector."""
    as_array = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{key}`").cast("bigint").alias("key"), as_array.alias("vector")).where(usable(F.col("vector"), dims))
    centroids = starts(kept, clusters, salt, scale)
    if not len(centroids):
        return None
    va = build(vectors, key, vector, dims, scale, bits)
    blocks = va.blocks.withColumn("clusters", F.lit(None).cast("binary"))
    k = len(centroids)
    total, count, fetched = np.zeros((k, dims), object), np.zeros(k, object), []
    for turn in range(rounds + 1):
        made = _assigned(va, blocks, centroids)
        blocks = made.where("file is not null").select("file", "n", "cells", "clusters")
        fetched.append(made.agg(F.sum("fetched")).first()[0] or 0)
        if turn == rounds:
            break
        sums = made.where("cluster is not null").groupBy("cluster").agg(F.sum("moved").alias("moved"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)))
        for r in sums.collect():  # a row for each centroid at most
            count[r["cluster"]] += r["moved"]
            total[r["cluster"]] += np.array([r[f"s{d}"] for d in range(dims)], object)
        centroids = np.array([total[c] // count[c] if count[c] else centroids[c] for c in range(k)], object).astype(np.int64)
    return Clustering(va, blocks, centroids, fetched)


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def summary(vectors: DataFrame, clusters: int = 40, rounds: int = 5, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """Each vector's cluster and squared distance, with the sums of its cluster and of all, and its centroid's digest."""
    found = cluster(vectors, clusters, rounds, key, vector, dims, scale, salt)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    members = stored(found.members(), "members")
    sums = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid at most
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    own = F.col("cluster") + 1
    return members.select(
        F.col("key").alias("vec_id"), "cluster", "distance",
        F.element_at(F.array(*(F.lit(sums.get(c, 0)).cast("bigint") for c in range(len(names)))), own).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.element_at(F.array(*map(F.lit, names)), own).alias("centroid_sha256"),
    )
