"""Exact top-k search by inner product: tiles of queries and shards of candidates.

Components become whole numbers, floor(scale * x), so scores are exact. Queries are dealt to blocks and candidates to
shards, each of at most ``TILE_BYTES`` of numbers; a tile is one block against one shard, in one task of its own. It multiplies
strips of both as matrices, keeps of every strip the k + 1 best of each query by a partial selection, and gives one short list
for each query. Lists of ``FAN`` shards at a time are merged in a tree, so no task gathers all lists of a query. Products are float64
matrix products where no sum can pass 2^53, and products of Python's whole numbers elsewhere.

Rows are written once with a number of their own, so a lost executor's tasks deal them to the same tiles again. The query's own
row is among its k + 1 best or no help to it, so it leaves the merged list by its id and its score with itself.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query or as candidate; where
lengths differ the missing components count as zero, so an empty vector scores 0 with all; equal scores go to the smaller
vec_id, null last; a null vec_id is no query but a candidate; of repeated rows each is a query and the other's candidate; a score beyond
a long counts as the nearest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialise

K, SCALE, EVERY = 10, 1024, 100
#: Bytes of numbers in a block or a shard at most; rows of a shard where there are fewer shards than cores.
TILE_BYTES, TILE_ROWS = 32 << 20, 2048
#: Queries and candidates of one matrix product; lists merged at once.
STRIP, FAN = (512, 4096), 32
#: Sums of products below this are exact in float64.
EXACT = 1 << 53
_LAST = np.iinfo("int64").max


def finite_only(vector: Column) -> Column:
    """False for vectors that are null or hold a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as float64 where that is exact, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        found = np.floor(values * float(scale))
    if not len(values.ravel()) or np.abs(found).max() < EXACT:
        return found
    each = [math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in values.ravel().tolist()]
    return np.array(each, object).reshape(values.shape)


def matrix(vectors: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` whole numbers, zero behind a short one's end."""
    rows = vectors.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype("float64")
    sizes = np.diff(rows.offsets.to_numpy())
    found = np.zeros((len(rows), width))
    found[np.arange(width) < sizes[:, None]] = flat
    return whole_numbers(found, scale)


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: float64, or whole numbers in objects where a sum could pass 2^53."""
    if queries.dtype != object and shard.dtype != object and float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * queries.shape[1] < EXACT:
        return queries @ shard.T
    a, b = (np.array([int(x) for x in m.ravel()], object).reshape(m.shape) for m in (queries, shard))
    return np.clip(a @ b.T, -_LAST - 1, _LAST)


def best(found: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores, equal ones by the smaller column: (scores, at's columns), best first."""
    k = min(k, found.shape[1])
    least = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
    row, column = np.nonzero(found >= least[:, None])
    order = np.lexsort((column, -found[row, column], row)) if found.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -found[row[i], column[i]], column[i])))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(found)))
    take = start[:, None] + np.arange(k)
    return found[row[take], column[take]], at[np.arange(len(found))[:, None], column[take]]


def tile(queries: np.ndarray, shard: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k best rows of the shard, earlier rows first among equals: (scores, rows)."""
    tops, rows = [], []
    for i in range(0, len(queries), STRIP[0]):
        mine = queries[i : i + STRIP[0]]
        top, place = None, None
        for j in range(0, len(shard), STRIP[1]):
            found = scores(mine, shard[j : j + STRIP[1]])
            at = np.broadcast_to(np.arange(j, j + found.shape[1]), found.shape)
            found, at = best(found, at, k)
            if top is not None:  # what came before lies before it, so equal scores keep their order
                if top.dtype != found.dtype:
                    top, found = top.astype(object), found.astype(object)
                found, at = best(np.concatenate([top, found], axis=1), np.concatenate([place, at], axis=1), k)
            top, place = found, at
        tops.append(top)
        rows.append(place)
    if any(t.dtype == object for t in tops):
        tops = [t.astype(object) for t in tops]
    return np.concatenate(tops), np.concatenate(rows)


_LIST = "array<struct<lost:long,vec_id:long,score:long>>"


def _tiles(both: DataFrame, width: int, k: int, scale: int) -> DataFrame:
    """Rows (block, shard, candidate, row, vec_id, vector) -> of each query in each tile its list of k + 1."""

    def run(table: pa.Table) -> pa.Table:
        side = table["candidate"].to_numpy()
        mine, other = table.filter(pa.array(~side)), table.filter(pa.array(side)).sort_by("vec_id")  # nulls come last
        if not mine.num_rows or not other.num_rows:
            return schema.empty_table()
        a, c = matrix(mine["vector"], width, scale), matrix(other["vector"], width, scale)
        found, at = tile(a, c, k + 1)
        own = np.array([int(scores(x, x)[0, 0]) for x in np.split(a, len(a))], "int64")
        ids = other["vec_id"].combine_chunks().take(pa.array(at.ravel()))
        n = found.shape[1]
        found = found.astype("int64")
        items = pa.StructArray.from_arrays([pa.array(-1 - found.ravel()), ids, pa.array(found.ravel())], ["lost", "vec_id", "score"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype="int32") * n), items)
        shard = pa.array(np.full(len(a), table["shard"][0].as_py(), "int32"))
        return pa.table([mine["row"], mine["vec_id"], pa.array(own), shard, lists], names=["row", "query_id", "own", "shard", "top"])

    item = pa.struct([("lost", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("shard", pa.int32()), ("top", pa.list_(item))])
    arrow_rows(both.sparkSession)
    return both.groupBy("block", "shard").applyInArrow(run, f"row long, query_id long, own long, shard int, top {_LIST}")


def _first(lists: Column, most: int) -> Column:
    """The best of several lists; null ids last among equal scores."""
    keyed = F.transform(F.flatten(lists), lambda x: F.struct(x["lost"].alias("lost"), x["vec_id"].isNull().alias("none"), x["vec_id"].alias("vec_id"), x["score"].alias("score")))
    cut = F.slice(F.sort_array(keyed), 1, most)
    return F.transform(cut, lambda x: F.struct(x["lost"].alias("lost"), x["vec_id"].alias("vec_id"), x["score"].alias("score")))


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, tile_bytes: int = TILE_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vectors (vec_id, embedding): the k best candidates of every row whose vec_id is divisible by ``every``: query_id, rank
    (from 1), vec_id, score."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(finite_only(F.col("vector")))
    rows = materialise(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("vector"))).first()
    width = max(width or 0, 1)
    fit = max(1, tile_bytes // (8 * width))
    busy = min(-(-n // tile_rows), 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    shards = max(1, -(-n // fit), busy)
    blocks = max(1, -(-asked // fit))
    part = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(many)).cast("int")
    queries = rows.where(is_query).select(part(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(False).alias("candidate"), "row", "vec_id", "vector")
    others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(2, shards).alias("shard"), F.lit(True).alias("candidate"), "row", "vec_id", "vector")
    lists = _tiles(queries.union(others), width, k, scale)
    while True:
        lists = lists.groupBy("row", "query_id", "own", F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(_first(F.collect_list("top"), k + 1).alias("top"))
        if shards <= FAN:
            break
        shards = -(-shards // FAN)
    own = F.array_position(F.transform("top", lambda x: F.coalesce((x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("own")), F.lit(False))), F.lit(True))
    placed = lists.select("query_id", own.alias("_own"), F.posexplode("top").alias("_at", "_top")).withColumn("_at", F.col("_at") + 1)
    placed = placed.withColumn("rank", (F.col("_at") - F.when((F.col("_own") > 0) & (F.col("_own") < F.col("_at")), 1).otherwise(0)).cast("int"))
    return placed.where((F.col("_at") != F.col("_own")) & (F.col("rank") <= k)).select("query_id", "rank", "_top.vec_id", "_top.score")
