"""Lines, blocks and regions of a page."""

from __future__ import annotations

from bisect import bisect_left
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import numeric_cell
from ..functions.text import is_noise
from ..session import materialise
from .bands import meet
from .folds import fold_rows
from .geometry import cluster_1d, column_edges, fold_pages, nearest_column, split_cells, words_to_lines

# fixed values of tables without rules: least width and height of a word, share of a height within which words are of one
# line, gap between columns in median widths and at least, lines in which headings are looked for
LEAST_WIDTH, LEAST_HEIGHT, LINE_SHARE, GAP_WIDTHS, LEAST_GAP, HEAD_LINES = 8, 10, 0.55, 1.35, 18, 5


def centroid_lines(words: DataFrame, by: list[str], share: float = 0.55) -> DataFrame:
    """words (by, word_idx, y0, y1 and others) with ``line``: in the order of their middles a word joins the current line
    while its middle is within ``share`` of the median height of the mean of the line's middles."""

    def fold(y0: list[float], y1: list[float]) -> tuple[range, list[int]]:
        slack, total, n, line, lines = median(b - a for a, b in zip(y0, y1, strict=True)) * share, 0.0, 0, -1, []
        for a, b in zip(y0, y1, strict=True):
            mid = (a + b) / 2
            if n == 0 or abs(mid - total / n) > slack:
                line, total, n = line + 1, 0.0, 0
            total, n = total + mid, n + 1
            lines.append(line)
        return range(len(lines)), lines

    middle = words.withColumn("_m", (F.col("y0") + F.col("y1")) / 2)
    return fold_pages(middle, by, ["_m", "word_idx"], ["y0", "y1"], fold, "line int").drop("_m")


def overlaps(boxes: DataFrame, by: list[str], share: float = 0.3) -> DataFrame:
    """Pairs of a page's boxes (box_idx, x0, x1, line) on neighbouring lines that overlap sideways by at least ``share`` of
    the narrower: by, line, a, b."""
    below = boxes.select(*by, (F.col("line") - 1).alias("line"), F.col("box_idx").alias("b"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    shared = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("_x1") - F.col("_x0"))
    return boxes.join(below, [*by, "line"]).where(shared >= share * narrow).select(*by, "line", F.col("box_idx").alias("a"), "b")


def group_blocks(lines: DataFrame, boxes: DataFrame, by: list[str], least: int = 2, gap: float = 2.2) -> DataFrame:
    """lines (by, line, y0, y1) with ``block``: a line continues the one above if ``least`` columns agree and it is no more
    than ``gap`` heights below."""
    agree = overlaps(boxes, by).groupBy(*by, (F.col("line") + 1).alias("line")).agg(F.countDistinct("a").alias("_n"))
    w = Window.partitionBy(*by).orderBy("line")
    far = F.col("y0") - F.lag("y1").over(w) > gap * (F.col("y1") - F.col("y0"))
    rows = lines.join(agree, [*by, "line"], "left").withColumn("_new", F.when(F.lag("line").over(w).isNull() | far | (F.coalesce("_n", F.lit(0)) < least), 1).otherwise(0))
    return rows.withColumn("block", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int")).drop("_n", "_new")


def block_kind(width: Column, value: Column) -> Column:
    """text of one column, key_value of two unless the second is a long column of figures, else table; value: share of
    figures in the second column times rows."""
    return F.when(width <= 1, "text").when((width == 2) & (value < 4), "key_value").otherwise("table")


def attach_titles(regions: DataFrame, by: list[str], most: float = 2.5) -> DataFrame:
    """regions (by, region, kind, text, y0, y1, line_height): a short lone text right above a table becomes its title and
    is no region any more."""
    w = Window.partitionBy(*by).orderBy("region")
    title = (F.col("kind") == "text") & (F.length("text") <= 60) & (F.lead("kind").over(w) == "table") & (F.lead("y0").over(w) - F.col("y1") <= most * F.col("line_height"))
    marked = regions.withColumn("_t", F.coalesce(title, F.lit(False)))
    return marked.withColumn("title", F.when(F.lag("_t").over(w), F.lag("text").over(w))).where("NOT _t").drop("_t")


def layout_header(cells: Column) -> Column:
    """May a row be headings? Words only, two at least, none long, no date, time or money."""
    texts = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda t: t != "")
    plain = F.forall(texts, lambda t: numeric_cell(t).isNull() & (F.length(t) <= 40) & t.rlike(r"\p{L}") & ~t.rlike(r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d:\d\d|[$€£¥]"))
    return (F.size(texts) >= 2) & plain


def masthead(sections: DataFrame, by: list[str]) -> DataFrame:
    """The first section (section, kind, text) of a page, if it is a single short line."""
    first = sections.groupBy(*by).agg(F.min_by(F.struct("kind", "text"), "section").alias("f"))
    return first.where((F.col("f.kind") == "text") & (F.length("f.text") <= 60) & ~F.col("f.text").contains("\n")).select(*by, F.col("f.text").alias("masthead"))


def serial_chain(words: DataFrame, by: list[str], least_gap: float = 8.0) -> DataFrame:
    """words (by, word_idx, value: long, y0, conf): those of the longest chain down the page in which each number is followed by
    the next number's first place at least ``least_gap`` below; of equally long ones the surest, then the first."""

    def fold(value: list[int], y0: list[float], conf: list[float]) -> tuple[list[int], list[int]]:
        n = len(value)
        after, length, sure = [-1] * n, [1] * n, list(conf)
        below: dict[int, tuple[list[float], list[int]]] = {}  # of each number: places below, from the bottom up
        for i in range(n - 1, -1, -1):
            heights, rows = below.get(value[i] + 1, ((), ()))
            at = bisect_left(heights, -(y0[i] + least_gap) + 1e-9) if heights else 0
            j = rows[at - 1] if at else -1
            if j >= 0:
                after[i], length[i], sure[i] = j, length[j] + 1, conf[i] + sure[j]
            own = below.setdefault(value[i], ([], []))
            own[0].append(-y0[i])
            own[1].append(i)
        at = max(range(n), key=lambda i: (length[i], sure[i], -i))
        kept = []
        while at >= 0:
            kept.append(at)
            at = after[at]
        return kept, list(range(len(kept)))

    return fold_pages(words, by, ["y0", "word_idx"], ["value", "y0", "conf"], fold, "place int")


def uniform_rows(lines: DataFrame, by: list[str], spread: float = 0.28) -> DataFrame:
    """lines (by, line, height) of a page's grid that are its even rows. All stay where there are fewer than four, where heights
    (12 at least) deviate by less than ``spread`` of their median, or where no run of heights from 0.5 to 1.8 of the median is
    as long as three lines and a third of the page; else the longest such run, the first of equal ones, and the page's first line."""
    tall = lines.withColumn("_h", F.greatest(F.lit(12.0), F.col("height")))
    page = tall.groupBy(*by).agg(F.median("_h").alias("_m"), F.stddev_pop("_h").alias("_d"), F.count(F.lit(1)).alias("_n"), F.min("line").alias("_first"))
    w = Window.partitionBy(*by).orderBy("line")
    fits = F.col("_h").between(0.5 * F.col("_m"), 1.8 * F.col("_m"))
    runs = tall.join(page, by).withColumn("_fits", fits).withColumn("_i", F.sum(F.when(fits, 0).otherwise(1)).over(w))
    found = runs.where("_fits").groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_k"))
    best = found.groupBy(*by).agg(F.max_by(F.struct("_i", "_k"), F.struct(F.col("_k"), -F.col("_i"))).alias("_b"))
    runs = runs.join(best, by, "left")
    even = (F.col("_n") < 4) | (F.col("_d") / F.col("_m") < spread) | (F.coalesce(F.col("_b._k"), F.lit(0)) < F.greatest(F.lit(3), F.floor(F.col("_n") / 3)))
    return runs.where(even | (F.col("_fits") & (F.col("_i") == F.col("_b._i"))) | (F.col("line") == F.col("_first"))).select(*lines.columns)


def label_values(words: DataFrame, by: list[str]) -> DataFrame:
    """words (by, line, x0, text): on each line the words up to one that ends in a colon are a label, those up to the next
    label its value. The widest gap between two labels parts the value from the next label: by, line, label, value."""
    w = Window.partitionBy(*by, "line").orderBy("x0")
    to_here = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = words.withColumn("_n", F.coalesce(F.sum(F.col("text").rlike("[:：]$").cast("int")).over(to_here), F.lit(0))).withColumn("_gap", F.col("x0") - F.lag("x1").over(w))
    colon = F.col("text").rlike("[:：]$")
    widest = rows.where("_n > 0").groupBy(*by, "line", "_n").agg(F.bool_or(colon).alias("_more"), F.max_by("x0", F.struct(F.coalesce("_gap", F.lit(0.0)), -F.col("x0"))).alias("_cut"))
    rows = rows.join(widest, [*by, "line", "_n"], "left")
    is_label = (F.col("_n") == 0) | (F.col("_more") & (F.col("x0") >= F.col("_cut")))
    number = F.when(is_label, F.col("_n") + 1).otherwise(F.col("_n"))
    text = lambda label: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_label if label else ~is_label, F.struct("x0", "text")))), lambda x: x["text"]), " ")
    pairs = rows.groupBy(*by, "line", number.alias("k")).agg(text(True).alias("label"), text(False).alias("value"))
    return pairs.where(F.col("label").rlike("[:：]$") & (F.col("value") != "")).select(*by, "line", F.regexp_replace("label", r"\s*[:：]$", "").alias("label"), "value")


def page_direction(pages: DataFrame, by: list[str]) -> DataFrame:
    """rtl if more than half of a document's pages (rtl: boolean) are."""
    return pages.groupBy(*by).agg(F.when(F.avg(F.col("rtl").cast("double")) > 0.5, "rtl").otherwise("ltr").alias("direction"))


def grid_cells(lines: DataFrame, by: list[str], least: float = 8.0, least_width: float | None = None) -> DataFrame:
    """lines (by, axis: 'x' or 'y', at) of a ruled grid -> its cells between neighbouring lines at least ``least`` apart
    (``least_width`` sideways): by, r, c, x0, x1, y0, y1. Rows with fewer than three cells go."""
    def spans(axis: str, name: str, index: str, least: float) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("at")
        s = lines.where(F.col("axis") == axis).select(*by, F.col("at").alias(f"{name}0"), F.lead("at").over(w).alias(f"{name}1")).where(F.col(f"{name}1") - F.col(f"{name}0") >= least)
        return s.withColumn(index, F.row_number().over(Window.partitionBy(*by).orderBy(f"{name}0")) - 1)

    cells = spans("y", "y", "r", least).join(spans("x", "x", "c", least if least_width is None else least_width), by)
    enough = cells.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    return cells.join(enough, [*by, "r"], "left_semi").select(*by, "r", "c", "x0", "x1", "y0", "y1")


def clear_rules(rules: DataFrame, blocks: DataFrame, words: DataFrame, by: list[str], share: float = 0.6, slack: float = 2.0, width: float = 64.0) -> DataFrame:
    """Vertical rules (by, rule_idx, x, y0, y1) inside a block, over at least ``share`` of its height, that cross no word. A rule
    meets the blocks and words of its own band of the page only."""
    own = blocks.select(*by, *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")])
    tall = F.least("y1", "_y1") - F.greatest("y0", "_y0") >= share * (F.col("_y1") - F.col("_y0"))
    inside = meet(rules, own, by, F.col("x"), F.col("_x0"), F.col("_x1"), width, tall & (F.col("x") > F.col("_x0")) & (F.col("x") < F.col("_x1")), "left_semi")
    w = words.select(*by, (F.col("x0") + slack).alias("_x0"), (F.col("x1") - slack).alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    crossed = (F.col("_x0") < F.col("x")) & (F.col("_x1") > F.col("x")) & (F.col("_y0") < F.col("y1")) & (F.col("_y1") > F.col("y0"))
    return meet(inside.distinct(), w, by, F.col("x"), F.col("_x0"), F.col("_x1"), width, crossed, "left_anti")


def aligned_table(words: DataFrame, by: list[str]) -> DataFrame:
    """words (by, word_idx, text, x0, x1, y0, y1) of a table without rules -> by, line, column_idx, text of its filled cells.

    A word with bars, slashes or equals signs is cut there. A word joins the first line whose first word's middle is within
    ``LINE_SHARE`` of the greater height. Middles along the page make groups: these are the columns, unless the fullest of the
    first ``HEAD_LINES`` lines (the first of equal ones) has nearly as many words as there are groups, which are then the
    columns. A page with a single group has a single column.
    """
    size = lambda a, b, least: F.greatest(F.floor(F.coalesce(F.col(b) - F.col(a), F.lit(0.0))), F.lit(least))
    pieces = F.filter(F.split("text", "[|/=]+"), lambda t: F.trim(t) != "")
    cut = words.select(*by, "word_idx", size("x0", "x1", LEAST_WIDTH).alias("_w"), F.floor("x0").alias("_x"), F.floor("y0").alias("_y"), size("y0", "y1", LEAST_HEIGHT).alias("_h"), pieces.alias("_parts"), F.trim("text").alias("_t")).where("_t <> ''")
    several = F.size("_parts") > 1
    cut = cut.select(*by, "word_idx", "_w", "_x", "_y", "_h", several.alias("_many"), F.size("_parts").alias("_n"), F.posexplode(F.when(several, F.col("_parts")).otherwise(F.array("_t"))).alias("_i", "text"))
    step = F.col("_w") / F.col("_n")
    left = F.when(F.col("_many"), F.floor(F.col("_x") + F.col("_i") * step)).otherwise(F.col("_x"))
    width = F.when(F.col("_many"), F.greatest(F.floor(step), F.lit(LEAST_WIDTH))).otherwise(F.col("_w"))
    tokens = cut.select(*by, "word_idx", "_i", F.trim("text").alias("text"), left.alias("_x"), width.alias("_w"), "_y", "_h").withColumn("_m", F.col("_x") + F.col("_w") / 2)

    def line_of(state: list, y: float, height: float, tallest: float) -> tuple[int]:
        made, lines = state  # how many so far; number, middle and height of those within reach of the page's tallest word
        middle = y + height / 2
        lines = [x for x in lines if y + LEAST_HEIGHT / 2 - x[1] < tallest * LINE_SHARE]
        at = next((n for n, m, h in lines if abs(middle - m) < max(height, h) * LINE_SHARE), made)
        if at == made:
            made, lines = made + 1, [*lines, (made, middle, height)]
        state[:] = made, lines
        return (at,)

    tallest = tokens.withColumn("_tallest", F.max("_h").over(Window.partitionBy(*by)))
    lined = fold_rows(tallest, by, ["_y", "_x", "word_idx", "_i"], ["_y", "_h", "_tallest"], lambda: [0, []], line_of, "line int")
    tokens = materialise(lined.drop("_tallest"), "tokens")
    gaps = tokens.groupBy(*by).agg(F.greatest(F.floor(F.median("_w") * GAP_WIDTHS), F.lit(LEAST_GAP)).alias("_gap"))
    middles = tokens.join(gaps, by).select(*by, "_gap", F.floor("_m").alias("_f"))
    groups = cluster_1d(middles, by, "_f", F.col("_gap"), "_g").groupBy(*by, "_g").agg(F.avg("_f").alias("x"))
    counts = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("_groups"))
    fullest = tokens.where(F.col("line") < HEAD_LINES).groupBy(*by, "line").agg(F.count(F.lit(1)).alias("_k")).groupBy(*by).agg(F.max_by(F.struct("line", "_k"), F.struct("_k", -F.col("line"))).alias("_head"))
    pages = counts.join(fullest, by, "left").withColumn("_by_head", (F.col("_groups") > 1) & (F.col("_head._k") >= F.greatest(F.lit(3), F.col("_groups") - 1)))
    heads = tokens.join(pages.where("_by_head"), by).where(F.col("line") == F.col("_head.line")).select(*by, F.col("_m").alias("x"))
    centres = heads.unionByName(groups.join(pages.where("_by_head IS NOT TRUE"), by).select(*by, F.when(F.col("_groups") > 1, F.col("x")).otherwise(F.lit(0.0)).alias("x")))
    columns = centres.withColumn("column_idx", (F.row_number().over(Window.partitionBy(*by).orderBy("x")) - 1).cast("int"))
    placed = nearest_column(tokens.withColumn("x0", F.col("_m")).withColumn("x1", F.col("_m")), columns, by)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_x", "word_idx", "_i", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*by, "line", "column_idx").agg(joined.alias("text"))


def tables_of_words(words: DataFrame, by: list[str], gap: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """words (by, word_idx, text, conf, x0, x1, y0, y1) -> cells (by, block, line, column_idx, text, conf) and regions (by,
    block, kind, n_lines, n_columns, header_line, y0, y1).

    Noise goes; words make lines, lines are cut into boxes at gaps of ``gap`` median heights, lines whose boxes stand below
    each other make blocks, and the white space of a block parts its columns. A cell is as sure as its least sure word. Lines
    are the only step in Python; boxes are written to the shared folder, as all that follows reads them.
    """
    seen = words.where(~is_noise(F.col("text"), F.col("conf")))
    tall = F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy(*by)) * gap
    lined = words_to_lines(seen.select(*by, "word_idx", "text", "conf", "x0", "x1", "y0", "y1").withColumn("_gap", tall), by)
    scaled = lined.withColumnsRenamed({"x0": "_x0", "x1": "_x1"}).withColumn("x0", F.col("_x0") / F.col("_gap")).withColumn("x1", F.col("_x1") / F.col("_gap"))
    unit = split_cells(scaled, [*by, "line"], 1.0).drop("x0", "x1", "_gap").withColumnsRenamed({"_x0": "x0", "_x1": "x1"})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    boxes = unit.groupBy(*by, "line", "cell").agg(joined.alias("text"), F.min("conf").alias("conf"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))])
    boxes = materialise(boxes.withColumn("box_idx", F.shiftleft(F.col("line").cast("long"), 32) + F.col("cell")), "boxes")
    lines = boxes.groupBy(*by, "line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    placed = boxes.join(group_blocks(lines, boxes, by).select(*by, "line", "block"), [*by, "line"])
    own = [*by, "block"]
    columns = column_edges(placed, own).select(*own, "column_idx", ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    cells = nearest_column(placed.withColumn("word_idx", F.col("box_idx")), columns, own).groupBy(*own, "line", "column_idx").agg(joined.alias("text"), F.min("conf").alias("conf"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    rows = cells.groupBy(*own, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_idx", "text"))), lambda c: c["text"]).alias("t"))
    heads = rows.groupBy(*own).agg(F.min("line").alias("_first"), F.min_by(layout_header(F.col("t")), "line").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    sizes = cells.groupBy(*own).agg(F.countDistinct("line").alias("n_lines"), F.countDistinct("column_idx").alias("n_columns"), F.count_if((F.col("column_idx") == 1) & numeric_cell(F.col("text")).isNotNull()).alias("_figures"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    regions = sizes.join(heads, own)
    header = F.when(F.col("_head") & (F.col("_rows") > 1), F.col("_first"))
    return cells.drop("y0", "y1"), regions.select(*own, block_kind(F.col("n_columns"), F.col("_figures")).alias("kind"), "n_lines", "n_columns", header.alias("header_line"), "y0", "y1")
