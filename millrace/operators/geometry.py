"""Words with boxes: groups, lines, cells and columns. Everything is grouped by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import workers_import
from .folds import fold_rows


def cluster_1d(rows: DataFrame, by: list[str], value: str, gap: float | Column, out: str = "cluster") -> DataFrame:
    """``rows`` with the number (from 0) of their group along ``value``: a new one begins where the value is more
    than ``gap`` after the one before."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")


def split_cells(words: DataFrame, by: list[str], gap: float) -> DataFrame:
    """words (by, x0, x1) with ``cell``: a new one begins where a word starts more than ``gap`` to the right
    of all before it on the line."""
    w = Window.partitionBy(*by).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_new", F.when(F.col("x0") - before > gap, 1).otherwise(0)).withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")


def fold_pages(rows: DataFrame, by: list[str], order: list[str], needed: list[str], fold: Callable[..., tuple[Sequence[int], Sequence]], out: str) -> DataFrame:
    """An ordered fold of each page. ``fold`` gets the lists of the ``needed`` columns of a page, sorted by ``order``, and gives
    the numbers of the rows to keep and their values of the new column ``out`` (name and type).

    Pages come sorted, many in an Arrow batch, so a page costs no more than its rows; the last page of a batch waits for
    its next rows, and is put together once.
    """
    workers_import(rows.sparkSession)
    name = out.split()[0]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), out])

    def starts_of(frame: pd.DataFrame) -> list[int]:
        codes = [pd.factorize(frame[k], use_na_sentinel=False)[0] for k in by]
        return [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist()]

    def pages(parts: list[pd.DataFrame]) -> pd.DataFrame:
        held = pd.concat(parts, ignore_index=True)
        starts = starts_of(held)
        lists = [held[c].tolist() for c in needed]
        index, values = [], []
        for a, b in zip(starts, [*starts[1:], len(held)], strict=True):
            keep, made = fold(*(x[a:b] for x in lists))
            index += [a + i for i in keep]
            values += made
        return held.iloc[index].assign(**{name: values})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the page that the last batch ended in
        for batch in batches:
            if batch.empty:
                continue
            last = starts_of(batch)[-1]
            same = not held or len(starts_of(pd.concat([held[-1].tail(1), batch.head(1)]))) == 1
            if last > 0 or not same:
                yield pages([*held, batch.iloc[:last]] if last else held)
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield pages(held)

    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def words_to_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """words (by, word_idx, y0, y1 and others) with ``line``. In the order of their middles a word joins the
    latest line whose last word's middle is within half the smaller height.

    Middles only grow, so a line that is more than half its last word's height above one word is out of reach for all
    later ones: what is carried from word to word is the lines within reach, not the page.
    """

    def step(state: list, y0: float, y1: float) -> tuple[int]:
        lines, within = state  # how many so far; those within reach: middle and height of their last words, number
        mid, height = (y0 + y1) / 2, y1 - y0
        within = [x for x in within if mid - x[0] <= x[1] / 2]
        at = next((i for i in range(len(within) - 1, -1, -1) if abs(mid - within[i][0]) <= min(height, within[i][1]) / 2), len(within))
        line = within[at][2] if at < len(within) else lines
        within[at : at + 1] = [(mid, height, line)]
        state[:] = max(lines, line + 1), within
        return (line,)

    middle = words.withColumn("_m", (F.col("y0") + F.col("y1")) / 2)
    return fold_rows(middle, by, ["_m", "word_idx"], ["y0", "y1"], lambda: [0, []], step, "line int").drop("_m")


def _band(y: Column, height: float) -> Column:
    return F.floor(y / height).cast("long")


def words_to_cells(words: DataFrame, cells: DataFrame, by: list[str], slack: float = 3.0, band: float = 32.0) -> DataFrame:
    """words (by, word_idx, x0..y1) with ``cell_idx`` of the cell (by, cell_idx, x0..y1) that their centre lies in,
    give or take ``slack``; of several the one with the nearest centre; null if none.

    A page is cut into bands of height ``band``: a word meets the cells of its own band, not all of its page, and a page with
    very many words is dealt over tasks. A cell takes a row for each band that it reaches.
    """
    centres = words.withColumn("_x", (F.col("x0") + F.col("x1")) / 2).withColumn("_y", (F.col("y0") + F.col("y1")) / 2).withColumn("_b", _band(F.col("_y"), band))
    reach = F.sequence(_band(F.col("y0") - slack, band), _band(F.greatest("y0", "y1") + slack, band))
    boxes = cells.select(*by, "cell_idx", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(reach).alias("_b"))
    inside = (F.col("_x") >= F.col("_x0") - slack) & (F.col("_x") <= F.col("_x1") + slack) & (F.col("_y") >= F.col("_y0") - slack) & (F.col("_y") <= F.col("_y1") + slack)
    far = F.abs(F.col("_x") - (F.col("_x0") + F.col("_x1")) / 2) + F.abs(F.col("_y") - (F.col("_y0") + F.col("_y1")) / 2)
    found = centres.join(boxes, [*by, "_b"]).where(inside).groupBy(*by, "word_idx").agg(F.min_by("cell_idx", F.struct(far.alias("d"), F.col("cell_idx").alias("i"))).alias("cell_idx"))
    return words.join(found, [*by, "word_idx"], "left")


def nearest_column(words: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """words with ``column_idx`` of the column (by, column_idx, x) nearest to their middle, the first of equal
    ones; null without a column or a place.

    Words and columns of a page are sorted together: the nearest column is the last one before a word or the first one after
    it, so no word meets all columns.
    """
    kind = words.schema
    at = columns.where("x IS NOT NULL").groupBy(*by, F.col("x").alias("_at")).agg(F.min("column_idx").alias("_c"))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind if f.name not in by]
    placed = words.select("*", ((F.col("x0") + F.col("x1")) / 2).alias("_at"), F.lit(None).cast(at.schema["_c"].dataType).alias("_c"), F.lit(True).alias("_word"))
    both = placed.unionByName(at.select(*by, *absent, "_at", "_c", F.lit(False).alias("_word")))
    w = Window.partitionBy(*by).orderBy("_at", "_word")
    column = F.when(~F.col("_word"), F.struct("_at", "_c"))
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("_at"), "_word").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_p", before).withColumn("_n", after).where("_word")
    near = lambda side: F.when(F.col(side).isNotNull() & F.col("_at").isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{side}._at")).alias("d"), F.col(f"{side}._c").alias("i")))
    return both.select(*words.columns, F.least(near("_p"), near("_n"))["i"].alias("column_idx"))


def column_edges(words: DataFrame, by: list[str], bucket: int = 2, gap: int = 2) -> DataFrame:
    """Columns of a page from its white space: by, column_idx, x0, x1. Buckets that a word covers are islands; a
    hole of at least ``gap`` buckets ends a column."""
    a, b = F.floor(F.col("x0") / bucket), F.floor(F.col("x1") / bucket)
    islands = islands_of(words.where("x0 IS NOT NULL AND x1 IS NOT NULL").select(*by, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_z")), by, F.lit(float(gap)), "column_idx")
    return islands.groupBy(*by, "column_idx").agg((F.min("_a") * bucket).cast("double").alias("x0"), ((F.max("_z") + 1) * bucket).cast("double").alias("x1"))


def islands_of(spans: DataFrame, by: list[str], gap: Column, out: str) -> DataFrame:
    """spans (by, _a, _z: first and last bucket) with the number ``out`` of their island: a new one begins where a span's first bucket is
    more than ``gap`` after all buckets of the spans before it. Equal spans are one row; no span is dealt out into its buckets."""
    w = Window.partitionBy(*by).orderBy("_a", "_z")
    before = F.max("_z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_a") - before > gap, 1).otherwise(0)
    return spans.distinct().withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def value_below(labels: DataFrame, words: DataFrame, by: list[str], most: float = 78.0) -> DataFrame:
    """labels (by, label_idx, x0, y1) with the word below at most ``most`` away that costs least: sideways distance
    and a third of the downward one. A label meets the words of two bands of height ``most``."""
    under = words.select(*by, F.col("word_idx"), F.col("text").alias("value"), F.col("x0").alias("_x"), F.col("y0").alias("_y"), _band(F.col("y0"), most).alias("_b"))
    here = labels.select(*by, "label_idx", "x0", "y1", F.explode(F.array(_band(F.col("y1"), most), _band(F.col("y1"), most) + 1)).alias("_b"))
    down = F.col("_y") - F.col("y1")
    cost = F.abs(F.col("_x") - F.col("x0")) + 0.35 * down
    found = here.join(under, [*by, "_b"]).where((down >= 0) & (down <= most)).groupBy(*by, "label_idx").agg(F.min_by(F.struct("word_idx", "value"), F.struct(cost.alias("c"), "word_idx")).alias("v"))
    return labels.join(found.select(*by, "label_idx", "v.*"), [*by, "label_idx"], "left")


def suppress(words: DataFrame, by: list[str], most: float = 0.55) -> DataFrame:
    """Non-maximum suppression: in order of confidence a word stays unless it overlaps one that stays by more than
    ``most`` of the smaller box; the one that stays keeps its text as an alternative. A word is held against those of the
    bands that its box reaches."""

    def fold(x0: list, x1: list, y0: list, y1: list, text: list) -> tuple[list[int], list[list[str]]]:
        kept: list[int] = []
        others: list[list[str]] = []
        area = [max((b - a) * (d - c), 1e-9) for a, b, c, d in zip(x0, x1, y0, y1, strict=True)]
        height = max(median(b - a for a, b in zip(y0, y1, strict=True)), 1e-9)
        bands: dict[int, list[int]] = {}  # places in ``kept`` by the bands that their boxes reach
        high: list[int] = []  # of boxes that reach very many
        for i in range(len(text)):
            first, last = y0[i] // height, y1[i] // height
            reached = [int(first) + k for k in range(int(last - first) + 1)] if last - first < 64 else []
            close = set().union(*(bands.get(b, ()) for b in reached), high) if reached else range(len(kept))
            for at in sorted(close):
                k = kept[at]
                shared = max(0, min(x1[i], x1[k]) - max(x0[i], x0[k])) * max(0, min(y1[i], y1[k]) - max(y0[i], y0[k]))
                if shared / min(area[i], area[k]) > most:
                    others[at].append(text[i])
                    break
            else:
                for b in reached:
                    bands.setdefault(b, []).append(len(kept))
                if not reached:
                    high.append(len(kept))
                kept.append(i)
                others.append([])
        return kept, others

    ordered = words.withColumn("_c", -F.col("conf"))
    return fold_pages(ordered, by, ["_c", "word_idx"], ["x0", "x1", "y0", "y1", "text"], fold, "alternatives array<string>").drop("_c")
