"""What a column as a whole says: currency, decimals, stray glyphs, percent, headings from values.

Cells come in long form (keys, r: row, c: column, text); columns are aggregates, so that long tables cost no more
than their scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import currency_code, numeric_cell
from ..functions.text import EMAIL
from ..functions.vocab import ROLE_WORDS

_IDENTIFIER = r"(?iU)\b(?:code|no\.?|number|id|serial|ref|phone|tel)\b|رقم"


def currency_vote(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, currency: the most frequent mark of a document's cells, of equal ones the one seen first."""
    marks = cells.withColumn("_c", currency_code(F.col("text"))).where("_c IS NOT NULL")
    counts = marks.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "c")).alias("at"))
    return counts.groupBy(*by).agg(F.max_by("_c", F.struct(F.col("n"), -F.col("at.r"), -F.col("at.c"))).alias("currency"))


def decimal_places(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, c, places: the usual number of decimals of a column's figures, where enough of them have a point."""
    figures = cells.where(numeric_cell(F.col("text")).isNotNull()).withColumn("_d", F.nullif(F.length(F.regexp_extract("text", r"[.٫](\d+)\D*$", 1)), F.lit(0)))
    counts = figures.groupBy(*by, "c", "_d").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "c").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("_d").isNotNull(), F.col("n"))).alias("dotted"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.struct(F.col("n"), -F.col("_d")))).alias("places"))
    return best.where(F.col("dotted") >= F.greatest(F.lit(3.0), 0.4 * F.col("all"))).select(*by, "c", "places")


def restore_decimals(cells: DataFrame, by: list[str]) -> DataFrame:
    """Figures that lost their point, in columns with a usual number of decimals, get it back as ``restored``; an option
    that no query uses by itself, for it changes values."""
    places = decimal_places(cells, by)
    bare = F.trim("text").rlike(r"^\d+$") & (F.length(F.trim("text")) > F.col("places"))
    cut = F.length(F.trim("text")) - F.col("places")
    made = F.concat(F.substring(F.trim("text"), F.lit(1), cut), F.lit("."), F.substring(F.trim("text"), cut + 1, F.col("places")))
    return cells.join(places, [*by, "c"], "left").withColumn("restored", F.when(bare, made).otherwise(F.col("text"))).drop("places")


def isolated_glyphs(cells: DataFrame, by: list[str], least: int = 3, share: float = 0.7) -> DataFrame:
    """A lone O, I, l, S or $ in a column of small whole numbers becomes the digit it looks like, marked."""
    small = F.trim("text").rlike(r"^\d{1,3}$")
    counts = cells.where(F.trim("text") != "").groupBy(*by, "c").agg(F.count_if(small).alias("_n"), F.count(F.lit(1)).alias("_all"))
    fits = (F.col("_n") >= least) & (F.col("_n") >= share * F.col("_all"))
    lone = fits & F.trim("text").rlike(r"^[OoIlS$]$")
    joined = cells.join(counts, [*by, "c"], "left")
    return joined.withColumn("repaired", F.coalesce(lone, F.lit(False))).withColumn("text", F.when(lone, F.translate(F.trim("text"), "OoIlS$", "001155")).otherwise(F.col("text"))).drop("_n", "_all")


def semantic_headings(cells: DataFrame, headings: DataFrame, by: list[str]) -> DataFrame:
    """headings (by, c, heading) with the meaning that values prove: e-mail or phone where most are, row_number for a first
    column (c = 0) of whole numbers, most of which count up by one. Quantities and the like may count up by chance."""
    w = Window.partitionBy(*by, "c").orderBy("r")
    whole = F.when(F.trim("text").rlike(r"^\d{1,9}$"), F.trim("text").try_cast("long"))
    rows = cells.where(F.trim("text") != "").withColumn("_v", whole).withColumn("_up", F.col("_v") == F.lag("_v").over(w) + 1)
    email, phone = F.trim("text").rlike(f"(?i)^{EMAIL[4:]}$"), F.col("text").rlike(r"^\s*\+?\d[\d ()-]{6,}\d\s*$") & ~F.col("text").rlike(r"^\s*\d{1,6}\s*$")
    stats = rows.groupBy(*by, "c").agg(F.avg(email.cast("double")).alias("_e"), F.avg(phone.cast("double")).alias("_p"), F.count_if("_up").alias("_u"), F.count("_v").alias("_w"), F.count(F.lit(1)).alias("_n"))
    named = F.when(F.col("_e") >= 0.65, "email").when(F.col("_p") >= 0.65, "phone").when((F.col("c") == 0) & (F.col("_n") >= 3) & (F.col("_w") == F.col("_n")) & (F.col("_u") >= 0.8 * (F.col("_n") - 1)), "row_number")
    return headings.join(stats, [*by, "c"], "left").withColumn("heading", F.coalesce(named, "heading")).drop("_e", "_p", "_u", "_w", "_n")


def number_columns(cells: DataFrame, columns: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """columns (by, c, heading, role) with ``as_number``: a column without a role, no identifier by its heading, no
    leading zeros, and mostly figures; and ``percent``: its heading says so, or it is a tax or discount column of fractions."""
    value = numeric_cell(F.col("text"))
    stats = cells.where(F.trim("text") != "").groupBy(*by, "c").agg(F.avg(value.isNotNull().cast("double")).alias("s"), F.bool_or(F.trim("text").rlike(r"^0\d")).alias("z"), F.bool_and(F.coalesce((value > 0) & (value < 1), F.lit(False))).alias("f"))
    joined = columns.join(stats, [*by, "c"], "left")
    as_number = (F.col("role") == "other") & ~F.col("heading").rlike(_IDENTIFIER) & ~F.coalesce("z", F.lit(False)) & (F.coalesce("s", F.lit(0.0)) >= share)
    percent = F.col("heading").contains("%") | (F.col("role").isin("tax", "discount") & F.coalesce("f", F.lit(False)))
    return joined.withColumn("as_number", as_number).withColumn("percent", percent).drop("s", "z", "f")


def amount_columns(headings: DataFrame, by: list[str]) -> DataFrame:
    """The first column whose heading names each amount: by, role, c."""
    found = None
    for role, pattern in (("tax_rate", r"(?iU)(?:tax|vat)\s*(?:rate|%)|نسبة"), ("taxable", r"(?iU)taxable|الخاضع"), ("vat", r"(?iU)\b(?:vat|tax)\b|ضريبة"), *((r, p) for r, p, _ in ROLE_WORDS if r in ("qty", "unit_price", "line_total"))):
        test = F.col("heading").rlike(pattern)
        found = F.when(test, role) if found is None else found.when(test, role)
    return headings.withColumn("role", found).where("role IS NOT NULL").groupBy(*by, "role").agg(F.min("c").alias("c"))


def plan_columns(printed: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Columns of a sheet: those printed (by, c, heading), in order, but for unnamed ones without any value, then fields
    (by, item, key, value) that no heading names: by, position, heading."""
    used = items.where(F.trim(F.coalesce("value", F.lit(""))) != "").select(*by, F.lower("key").alias("_k"), "key").groupBy(*by, "_k").agg(F.min("key").alias("key"))
    named = printed.withColumn("_k", F.lower("heading"))
    kept = named.join(used.select(*by, "_k", F.lit(True).alias("_u")), [*by, "_k"], "left").where(F.coalesce("_u", F.lit(False)) | ~F.col("heading").rlike(r"(?i)^column_\d+$"))
    extra = used.join(named.select(*by, "_k"), [*by, "_k"], "left_anti").select(*by, F.lit(1 << 30).alias("c"), F.col("key").alias("heading"))
    order = F.row_number().over(Window.partitionBy(*by).orderBy("c", "heading")) - 1
    return kept.select(*by, F.col("c").cast("int").alias("c"), "heading").union(extra).select(*by, order.alias("position"), "heading")


def header_columns(fields: DataFrame, by: list[str], preferred: tuple[str, ...], most: int = 20) -> DataFrame:
    """fields (by, key, value): preferred keys first, one column for each distinct value, at most ``most``."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("key"))
    order = F.struct(F.when(rank > 0, rank).otherwise(1 << 20).alias("rank"), F.col("key").alias("key"))
    value = F.lower(F.trim("value"))
    first = fields.where(value != "").groupBy(*by, value.alias("_v")).agg(F.min_by(F.struct("key", "value"), order).alias("f"), F.min(order).alias("_o"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_o")) - 1).where(F.col("position") < most).select(*by, "position", "f.key", "f.value")


def item_header(rows: DataFrame, by: list[str], scan: int = 50) -> DataFrame:
    """The first of a table's rows (row_idx, cells) that names the most kinds of item fields, three at least."""
    lines = F.array_join("cells", "\n")
    hits = sum((F.coalesce(lines.rlike(pattern.replace("(?iU)", "(?imU)")), F.lit(False)).cast("int") for _, pattern, _ in ROLE_WORDS), F.lit(0))
    scored = rows.where(F.col("row_idx") < scan).withColumn("_h", hits).where("_h >= 3")
    return scored.groupBy(*by).agg(F.max_by("row_idx", F.struct(F.col("_h"), -F.col("row_idx"))).alias("header_row"))


def mean_confidence(cells: DataFrame, by: list[str]) -> DataFrame:
    """Filled cells and their mean confidence, to one place; negative ones are unknown and do not count."""
    body = cells.where(F.trim("text") != "")
    return body.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 1).alias("confidence"))


def alternatives(readings: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """readings (by, text, conf): each text once with its best confidence, the ``most`` surest, as an array."""
    best = readings.groupBy(*by, "text").agg(F.max("conf").alias("conf"))
    ranked = best.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("conf"), "text"))).where(F.col("_k") <= most)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text", "conf"))), lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"))).alias("alternatives"))


def blank_unsure(text: Column, conf: Column, numeric: Column, least: float = 35.0) -> Column:
    """A numeric column's cell that hardly was seen is left blank."""
    return F.when(numeric & (conf < least), "").otherwise(text)
