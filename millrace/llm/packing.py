"""Best-fit packing of tokenised documents into fixed-length sequences by large-item matching.

The plan is made from the histogram of lengths alone: at most ``capacity`` counts reach the driver,
however many documents there are. Pieces above a third of the capacity are matched greedily, largest
first with the largest partner that fits, so that a sequence holds two of them at most; the others
fill the gaps best-fit, largest first, and open sequences of their own when no gap fits. Equal
lengths are interchangeable, so the plan is a list of runs: "from this rank on, so many pieces of
this length go into so many sequences from that one on". Every step of the plan uses up a length or a
group of equal sequences, which bounds the runs by a small multiple of the capacity.

Pieces then only need their rank among the pieces of their length. Ranks come from a window over
(length, salt) and the sums of the salts before, so that a length that many documents share is
spread over tasks.

Defined results: a null or empty text is the end id alone; a document longer than the capacity is
cut, all pieces but the last being full; repeated rows are separate items; an empty table gives no
rows; a null doc_id is kept as an item; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, ids_as_long, ids_as_text, materialise

CAPACITY = 2048
#: Pieces per salt: what one window group holds, about; pieces of equal id, number and ids are in one.
ROWS_PER_SALT = 500_000

_PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian uint32."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokens import encoder

        known = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = known.packed(text)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text").mapInPandas(encode, _PIECES))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, sequences, pieces in each, first sequence, first offset).

    counts: length -> number of pieces, lengths from 1 to ``capacity``.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n > 0}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    made = 0  # sequences so far
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first sequence, sequences)
    order: list[int] = []  # gaps that have groups, ascending

    def put(size: int, bins: int, each: int, first: int, offset: int) -> None:
        runs.append((size, ranks[size], bins, each, first, offset))
        ranks[size] += bins * each
        left[size] -= bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap > 0 and bins > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        mate = large[at] if at >= 0 else None
        bins = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
        if mate == size and left[size] == 1:
            mate, bins = None, 1
        if mate == size:
            put(size, bins, 2, made, 0)
        else:
            put(size, bins, 1, made, 0)
            if mate is not None:
                put(mate, bins, 1, made, size)
        leave(capacity - size - (mate or 0), made, bins)
        made += bins
        large = [s for s in large if left[s] > 0]

    for size in [s for s in left if 3 * s <= capacity]:
        while left[size] > 0:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                first, bins, gap = made, -(-left[size] // (capacity // size)), capacity
                made += bins
            else:
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            each = gap // size
            full = min(bins, left[size] // each)
            if full:
                put(size, full, each, first, capacity - gap)
                leave(gap - each * size, first, full)
            rest = bins - full
            if rest and left[size] > 0:
                some = left[size]
                put(size, 1, some, first + full, capacity - gap)
                leave(gap - some * size, first + full, 1)
                leave(gap, first + full + 1, rest - 1)
            else:
                leave(gap, first + full, rest)
    return runs


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length and any others; read more than once, so best a table) with
    sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    salts = max(16, -(-sum(counts.values()) // ROWS_PER_SALT))
    by = [F.col("length"), F.col("_salt")]
    told = [c for c in ("ids_crc32", "_row") if c in items.columns]  # rows of one id are dealt apart
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *told), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(sums, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    table = items.sparkSession.sparkContext.broadcast(np.array(runs, "int64").reshape(-1, 6))  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, start, _, each, first, offset = table.value.T
        big = int(start.max(initial=0)) + int(rank.max() if len(rank) else 0) + 1
        lengths, ranks = length.to_numpy("int64"), rank.to_numpy("int64")
        run = _last_not_after(size, start, lengths, ranks, big)
        turn = ranks - start[run]
        return pd.DataFrame({"sequence_id": first[run] + turn // each[run], "offset": offset[run] + turn % each[run] * lengths})

    placed = ranked.withColumn("_at", where("length", "_rank"))
    return placed.select(*[c for c in items.columns if c != "_row"], F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def _last_not_after(size: np.ndarray, start: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, big: int) -> np.ndarray:
    """Index of the run of each length with the last start that is not after the rank; runs are sorted
    by (size, start)."""
    if big < (1 << 50):
        return np.searchsorted(size * big + start, lengths * big + ranks, "right") - 1
    out = np.empty(len(lengths), "int64")  # ranks too large to pack with the length
    for s in np.unique(lengths):
        lo, hi = np.searchsorted(size, [s, s + 1])
        mine = lengths == s
        out[mine] = lo + np.searchsorted(start[lo:hi], ranks[mine], "right") - 1
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    The pieces are written to the shared folder once: the histogram and the placement read them.
    """
    made = pieces(docs, tokenizer, capacity, with_ids)
    table = materialise((made if with_ids else made.drop("ids")).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return place(table, capacity)
