"""Shared helpers: reading tables, the folder that all executors see, cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch, sound_unions, workers_import

__all__ = ["DOCUMENT_COLUMNS", "arrow_rows", "bounded_sample", "held_out", "ids_as_long", "ids_as_text", "materialise", "quantile_bounds", "range_part", "read_table", "scratch", "whole_groups"]

#: Columns of the documents table; pipeline stages but the last return these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows and bytes in one Arrow batch handed to Python: a batch ends with the row that fills either.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Parts of an id range at most: their bounds are constants of the plan. Beyond it parts grow, and are sorted on disk.
MOST_PARTS = 8192


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages, and let workers import the package. The bounds are the
    same for every operator, as a plan takes those that hold when it runs, not when it is made."""
    workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``keys`` as frames of whole groups, each of at least ``rows`` rows but for the last."""
    held: list[pd.DataFrame] = []
    n, enough = 0, rows
    for batch in batches:
        if batch.empty:
            continue
        held.append(batch)
        n += len(batch)
        if n < enough:
            continue
        frame = pd.concat(held, ignore_index=True)
        open_ = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        if open_.all():
            held, enough = [frame], 2 * n  # so that a large group is put together a few times only
            continue
        yield frame[~open_]
        held = [frame[open_]]
        n, enough = int(open_.sum()), rows
    if held:
        yield pd.concat(held, ignore_index=True)


def ids_as_text(df: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """``key`` as text, and ``columns``: pandas would turn whole numbers beside nulls into doubles."""
    return df.select(F.col(key).cast("long").cast("string").alias(key), *columns)


def ids_as_long(df: DataFrame, *keys: str) -> DataFrame:
    """The ids (``doc_id`` if none are named) as whole numbers again."""
    return df.withColumns({k: F.col(k).cast("long") for k in keys or ("doc_id",)})


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id, as text, modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def bounded_sample(rows: DataFrame, most: int, group: str, draw: str) -> DataFrame:
    """Of each group the rows with the smallest ``draw`` (a hash of what tells rows apart), ``most`` at most. Rows of
    equal draws count as copies of one row; ties are cut where the bound is reached.

    Draws spread evenly, so those below about ``3 * most`` in the group's number of draws hold its smallest ones: only these
    are counted and ranked, whatever the number of partitions, and copies are counted before they move. Where a group
    comes short its bound is raised. ``rows`` are read three times. What is broadcast has at most ``most`` narrow rows for each
    group: callers' groups are few, or make up their model."""
    spread = materialise(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(draw).alias("_draws")).withColumnRenamed(group, "_group"), "spread")
    share = 3.0
    while True:
        reach = (share * most + 200) / F.col("_draws")
        bound = F.when(reach >= 1, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + reach * 2.0**64).cast("long"))
        near = rows.select(group, draw).join(F.broadcast(spread.select("_group", bound.alias("_bound"))), F.col(group).eqNullSafe(F.col("_group"))).where(F.col(draw) <= F.col("_bound"))
        found = materialise(near.groupBy("_group", draw).agg(F.count(F.lit(1)).alias("_many")), "draws")
        got = found.groupBy(F.col("_group").alias("_g")).agg(F.sum("_many").alias("_got"))
        short = spread.join(F.broadcast(got), F.col("_group").eqNullSafe(F.col("_g")), "left").where(F.coalesce("_got", F.lit(0)) < F.least("_n", F.lit(most)))
        if short.isEmpty():
            break
        share *= 8
    before = F.coalesce(F.sum("_many").over(Window.partitionBy("_group").orderBy(draw).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = found.withColumn("_before", before).where(F.col("_before") < most).select("_group", F.col(draw).alias("_draw_"), F.least("_many", F.lit(most) - F.col("_before")).alias("_copies"))
    met = rows.join(F.broadcast(taken), F.col(group).eqNullSafe(F.col("_group")) & (F.col(draw) == F.col("_draw_")))
    one = met.groupBy("_group", "_draw_").agg(F.first(F.struct(*rows.columns)).alias("_row"), F.first("_copies").alias("_copies"))
    return one.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def quantile_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending values of ``key`` that cut the rows into parts of about equal
    count. One scan of that column alone; what comes back is bounded by ``MOST_PARTS``."""
    parts = min(parts, MOST_PARTS)
    if parts <= 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, F.lit(shares), F.lit(max(10_000, 10 * parts))).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_part(key: Column, bounds: Sequence[int]) -> Column:
    """The number of ``bounds`` below ``key`` (nulls count as lowest): ascending parts 0..len(bounds).

    The bounds are looked up in two steps of about the square root of their number each.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [list(bounds[i : i + width]) for i in range(0, len(bounds), width)]
    lasts = F.array(*[F.lit(b[-1]) for b in blocks[:-1]]) if len(blocks) > 1 else None
    block = F.size(F.filter(lasts, lambda b: b < key)) if lasts is not None else F.lit(0)
    nested = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    inside = F.size(F.filter(F.get(nested, block), lambda b: b < key))
    return F.when(key.isNull(), F.lit(0)).otherwise((block * width + inside).cast("int"))
