"""Rows of sheets: (source, sheet_idx, row_idx, cells array<string>). Order is carried in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) != ""


def drop_blank_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows with a cell that is not blank."""
    return rows.where(F.exists(cells, filled))


def pad(cells: Column, width: Column) -> Column:
    """``cells`` cut or filled with blanks to ``width``."""
    more = F.greatest(width - F.size(cells), F.lit(0))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), more)), F.lit(1), F.greatest(width, F.lit(0)))


def drop_empty_columns(rows: DataFrame, by: list[str], cells: str = "cells") -> DataFrame:
    """Blank rows go, rows are padded to their table's width, and columns that are blank in all rows of
    the table go. A table's kept columns are an aggregate of one array."""
    rows = drop_blank_rows(rows, cells)
    used = F.filter(F.transform(cells, lambda c, i: F.when(filled(c), i)), lambda i: i.isNotNull())
    kept = rows.select(*by, F.explode(used).alias("_i")).groupBy(*by).agg(F.sort_array(F.collect_set("_i")).alias("_kept"))
    blank = lambda i: F.coalesce(F.get(F.col(cells), i), F.lit(""))
    return rows.join(kept, by).withColumn(cells, F.transform("_kept", blank)).drop("_kept")


def first_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal ``by`` the first in ``order``. An aggregate, so a key that most rows have is
    reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (*by, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_f")
    return rows.groupBy(*by).agg(first).select(*by, *[f"_f.{c}" for c in (*order, *rest)])


def dedupe_rows(rows: DataFrame, scope: str = "source", cells: str = "cells", order: tuple[str, ...] = ("sheet_idx", "row_idx")) -> DataFrame:
    """The first of the rows of a file with equal cells, across its sheets. Rows of other lengths differ."""
    marked = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    key = F.sha2(F.concat_ws(chr(31), F.size(cells).cast("string"), F.array_join(marked, chr(31))), 256)
    return first_rows(rows.withColumn("_key", key), [scope, "_key"], list(order)).drop("_key")


def unique_headings(columns: DataFrame, by: list[str], name: str = "name", position: str = "position") -> DataFrame:
    """Blank headings named by their position, and repeats numbered, whatever their case."""
    named = F.when(filled(F.col(name)), F.trim(name)).otherwise(F.concat(F.lit("column_"), (F.col(position) + 1).cast("string")))
    columns = columns.withColumn(name, named)
    turn = F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(position))
    return columns.withColumn("_n", turn).withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_n")


def section_fill(rows: DataFrame, by: list[str], position: str, label: Column) -> DataFrame:
    """``rows`` with ``section``: the last label that is not null, in order."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(label, ignorenulls=True).over(w))


def sequence_repair(rows: DataFrame, by: list[str], position: str, value: str, least: int = 4, share: float = 0.8) -> DataFrame:
    """Numbers of a column that counts up by one, where most do: the others are overwritten and marked.
    The start is the most frequent difference between value and place, the smallest of equal ones."""
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(position)))
    start = F.col(value) - F.col("_place")
    counts = numbered.where(F.col(value).isNotNull()).groupBy(*by, start.alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    best = counts.groupBy(*by).agg(F.max_by("_start", F.struct(F.col("_n"), -F.col("_start"))).alias("_start"), F.max("_n").alias("_n"))
    best = best.join(sizes, by).where((F.col("_n") >= least) & (F.col("_n") >= share * F.col("_all"))).select(*by, "_start")
    joined = numbered.join(best, by, "left")
    wanted = F.when(F.col("_start").isNotNull(), F.col("_start") + F.col("_place")).otherwise(F.col(value))
    return joined.withColumn("repaired", F.coalesce(~wanted.eqNullSafe(F.col(value)), F.lit(False))).withColumn(value, wanted).drop("_place", "_start")
