"""Centroid clustering on subvector dictionaries: exact Lloyd rounds over whole numbers.

Components become whole numbers, floor(scale * x). Every task packs its rows into shards of ``SHARD`` vectors and
encodes each shard once without loss: the dimensions are cut into blocks of ``BLOCK``, a block's distinct subvectors form its
dictionary, and a vector is a code for each block. A round computes the squared distance of each dictionary entry to each
centroid once, adds up the entries' distances by code, and takes the nearest centroid; the sums of a cluster come from its
counts of codes times the dictionary. Shards send sums and counts of each centroid, which are added before and after one small
shuffle; what reaches the driver is one row for each component of a centroid. Shards are a written table, so each round reads them, and a lost
executor loses nothing.

All sums are whole numbers: 64-bit ones where no distance can pass 2^63, Python's elsewhere.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; equal
distances go to the smaller centroid; repeated rows count each time and may start as centroids each; equal hashes start
in the order of the vectors; fewer vectors than centroids give as many centroids as vectors; a null vec_id is hashed as an empty one; an
empty cluster keeps its centroid; components beyond 2^60 count as 2^60, and distances beyond a long are given as the largest
long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialise
from .topk import finite_only

K, ROUNDS, SCALE, WIDTH, SEED = 40, 5, 256, 64, 2
#: Dimensions of a block; vectors of a shard: some 16 MB of whole numbers.
BLOCK, SHARD = 2, 32_768
#: Components whose distances surely fit 64 bits; components count as no larger than that.
SMALL, LARGEST = 1 << 27, float(1 << 60)
_LONG = np.iinfo("int64").max


def whole_numbers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.astype("float64") * scale), -LARGEST, LARGEST).astype("int64")


def encode(vectors: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole numbers -> codes (vectors x blocks), the dictionaries of all blocks one below another, and the number
    of entries before each block's. Missing dimensions of the last block are zero."""
    n, width = vectors.shape
    blocks = -(-width // block)
    padded = np.zeros((n, blocks * block), "int64")
    padded[:, :width] = vectors
    codes, entries, before = np.empty((n, blocks), "<u4"), [], [0]
    for b in range(blocks):
        found, code = np.unique(padded[:, b * block : (b + 1) * block], axis=0, return_inverse=True)
        codes[:, b] = code.reshape(-1)
        entries.append(found)
        before.append(before[-1] + len(found))
    return codes, np.concatenate(entries) if entries else np.empty((0, block), "int64"), np.array(before, "int64")


def exact(entries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``entries`` in 64 bits where no distance can overflow, else as Python's whole numbers."""
    if max(abs(int(x)) for a in (entries, centroids) if a.size for x in (a.min(), a.max())) < SMALL:
        return entries
    return entries.astype(object)


def distances(codes: np.ndarray, entries: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids), added up by code from those of the dictionary entries."""
    block = entries.shape[1]
    total = np.zeros((len(codes), len(centroids)), "int64" if entries.dtype != object else object)
    for b in range(codes.shape[1]):
        own = centroids[:, b * block : (b + 1) * block]
        mine = entries[before[b] : before[b + 1], : own.shape[1]]
        table = np.zeros((len(mine), len(own)), total.dtype)
        for d in range(own.shape[1]):
            table += (mine[:, d : d + 1] - own[None, :, d]) ** 2
        total += table[codes[:, b]]
    return total


def cluster_sums(codes: np.ndarray, entries: np.ndarray, before: np.ndarray, cluster: np.ndarray, k: int, width: int) -> np.ndarray:
    """Sums of components (k x width): counts of codes times the dictionary."""
    block = entries.shape[1]
    out = np.zeros((k, codes.shape[1] * block), entries.dtype)
    for b in range(codes.shape[1]):
        mine = entries[before[b] : before[b + 1]]
        counts = np.bincount(cluster * len(mine) + codes[:, b], minlength=k * len(mine)).reshape(k, len(mine))
        out[:, b * block : (b + 1) * block] = counts.astype(entries.dtype) @ mine
    return out[:, :width]


_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("entries", pa.binary()), ("before", pa.binary())])


def encoded(kept: DataFrame, width: int = WIDTH, block: int = BLOCK, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """kept (vec_id, vector of ``width``) as encoded shards: ids, codes, entries, before."""

    def record(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["vector"].chunks])
        codes, entries, before = encode(whole_numbers(flat, scale).reshape(table.num_rows, width), block)
        return pa.record_batch([pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()]) for x in (codes, entries, before)]], schema=_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= shard:
                yield record(held)
                held, n = [], 0
        if n:
            yield record(held)

    arrow_rows(kept.sparkSession)
    return kept.select("vec_id", "vector").mapInArrow(run, "ids array<long>, codes binary, entries binary, before binary")


def _unpacked(batch: pa.RecordBatch, i: int, block: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    codes, entries, before = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("codes", "<u4"), ("entries", "<i8"), ("before", "<i8")))
    return batch["ids"][i].values, codes.reshape(-1, len(before) - 1), entries.reshape(-1, block), before


def _nearest(codes: np.ndarray, entries: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries in the numbers used, each vector's nearest centroid and its squared distance."""
    entries = exact(entries, centroids)
    cluster, least = np.empty(len(codes), "int64"), np.empty(len(codes), entries.dtype)
    for i in range(0, len(codes), 4096):
        found = distances(codes[i : i + 4096], entries, before, centroids if entries.dtype != object else centroids.astype(object))
        cluster[i : i + 4096] = found.argmin(axis=1)
        least[i : i + 4096] = found[np.arange(len(found)), cluster[i : i + 4096]]
    return entries, cluster, least


def round_sums(shards: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """For each centroid that has vectors, and each dimension: cluster, dim, n, total (decimal) of its vectors' components."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, codes, entries, before = _unpacked(batch, i, block)
                entries, cluster, _ = _nearest(codes, entries, before, centroids)
                sums, n = cluster_sums(codes, entries, before, cluster, k, width), np.bincount(cluster, minlength=k)
                has = np.flatnonzero(n)
                columns = [np.repeat(has, width).astype("int32"), np.tile(np.arange(width, dtype="int32"), len(has)), np.repeat(n[has], width)]
                totals = pa.array([str(x) for x in sums[has].reshape(-1).tolist()], pa.string())
                yield pa.record_batch([*map(pa.array, columns), totals], names=["cluster", "dim", "n", "total"])

    arrow_rows(shards.sparkSession)
    parts = shards.mapInArrow(run, "cluster int, dim int, n long, total string")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def start(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest hashes of their ids, as whole numbers."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(code.alias("_code"), "vector").orderBy("_code", "vector").limit(k).collect()
    return whole_numbers(np.array([r.vector for r in rows], "float64"), scale) if rows else np.empty((0, 0), "int64")


def assigned(shards: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, codes, entries, before = _unpacked(batch, i, block)
                _, cluster, least = _nearest(codes, entries, before, centroids)
                if least.dtype == object:
                    least = np.array([min(x, _LONG) for x in least], "int64")
                yield pa.record_batch([ids, pa.array(cluster.astype("int32")), pa.array(least)], names=["vec_id", "cluster", "distance"])

    arrow_rows(shards.sparkSession)
    return shards.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding) -> (vec_id, cluster, distance) as a written table, and the final centroids."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(finite_only(F.col("vector")) & (F.size("vector") == width))
    centroids = start(kept, k, seed, scale)
    shards = materialise(encoded(kept, width, block, scale, shard), "shards")
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in round_sums(shards, centroids, block).collect():  # a row for each component of a centroid
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    return materialise(assigned(shards, centroids, block), "assigned"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector's row with cluster_inertia, inertia and centroid_sha256."""
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    total = sum(int(r.s) for r in per)
    code = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    side = [(r.cluster, min(int(r.s), _LONG), min(total, _LONG), code[r.cluster]) for r in per]
    side = found.sparkSession.createDataFrame(side, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
