"""A document's sheet with live formulas, as data: a row for each cell, with its address, formula, and what the formula gives.

Addresses come from running offsets: an item's row is the heading's row, its place, and the group headings so far. Whoever writes
workbooks takes the cells as they are; nothing has to be computed again to be shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Totals in the order they are written, and the label of a sum that the page did not print.
TOTALS, COMPUTED = ("subtotal", "discount", "tax_amount", "grand_total", "amount_paid"), "computed_total"
READ = "read: "


def letter(index: int) -> str:
    """The name of a sheet's column, from 1: A to Z, AA and so on."""
    name = ""
    while index > 0:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _at(column: int, row: Column) -> Column:
    return F.concat(F.lit(letter(column)), row.cast("string"))


def _read(value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(READ), F.format_number(value, 2)))


_CELL = ("kind", "row", "column", "address", "text", "formula", "result", "note", "review")


def _cell(kind: str, row: Column, column: int, text: Column | None = None, formula: Column | None = None, result: Column | None = None, note: Column | None = None, review: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    given = (F.lit(kind), row.cast("int"), F.lit(column), _at(column, row), none("string") if text is None else text.cast("string"), none("string") if formula is None else formula, none("double") if result is None else result.cast("double"), none("string") if note is None else note, F.lit(False) if review is None else review)
    return F.struct(*[v.alias(n) for n, v in zip(_CELL, given, strict=True)])


def placed_items(items: DataFrame, by: list[str], header_row: int) -> DataFrame:
    """items (by, item_no, section) with ``row`` and ``opens``: whether a heading of its section is written above it. An item
    without a section leaves the last one open."""
    order = Window.partitionBy(*by).orderBy("item_no")
    before = F.last("section", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = items.withColumn("opens", F.col("section").isNotNull() & ~F.col("section").eqNullSafe(before))
    row = header_row + F.row_number().over(order) + F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("row", row.cast("int"))


def document_sheet(items: DataFrame, totals: DataFrame, by: list[str], fields: tuple[tuple[str, str], ...], header_row: int = 1) -> DataFrame:
    """items (by, item_no, section, review: array of fields, and the columns of ``fields``: name and role) and totals (by,
    subtotal, discount, tax_amount, grand_total, amount_paid, tax_rate; null: not printed) -> the sheet's cells below its
    headings: by, kind (group, item, label, total), row, column, address, text, formula, result, note, review.

    A line total is quantity times price where both are there, and what was read is its note; what makes it doubtful is
    marked at the quantity, which can be mended. A printed subtotal is the sum of the items' rows, a tax with a rate a share of
    it, a grand total beside a printed subtotal the sum of what stands above it. Where no sum is printed the sheet
    adds the items up under a label of its own. Documents without items or totals give no cells.
    """
    column = {role: i for i, (_, role) in enumerate(fields, start=1)}
    name = {role: f for f, role in fields}
    can = {"qty", "unit_price", "line_total"} <= set(column)
    row = F.col("row")
    doubtful = lambda field: F.coalesce(F.array_contains("review", field), F.lit(False))
    made = F.col(name["qty"]) * F.col(name["unit_price"]) if can else F.lit(None).cast("double")
    worth = F.coalesce(made, F.col(name["line_total"])) if "line_total" in column else F.lit(None).cast("double")
    rows = placed_items(items, by, header_row).withColumn("_made", made).withColumn("_worth", worth)
    cells = []
    for i, (field, role) in enumerate(fields, start=1):
        if role == "line_total" and can:
            formula = F.concat(F.lit("="), _at(column["qty"], row), F.lit("*"), _at(column["unit_price"], row))
            live = _cell("item", row, i, None, formula, F.col("_made"), _read(F.col(field)))
            cells.append(F.when(F.col("_made").isNotNull(), live).otherwise(_cell("item", row, i, result=F.col(field), review=doubtful(field))))
        elif role in ("qty", "unit_price", "line_total", "discount", "tax"):
            marked = doubtful(field) | (doubtful(name["line_total"]) & F.col("_made").isNotNull()) if role == "qty" and can else doubtful(field)
            cells.append(_cell("item", row, i, result=F.col(field), review=marked))
        else:
            cells.append(_cell("item", row, i, F.coalesce(F.trim(F.col(field)), F.lit("")), review=doubtful(field)))
    group = F.when(F.col("opens"), F.array(_cell("group", row - 1, 1, F.col("section")))).otherwise(F.slice(F.array(_cell("group", row - 1, 1, F.col("section"))), 1, 0))
    body = rows.select(*by, F.inline(F.concat(group, F.array(*cells))))

    bounds = rows.groupBy(*by).agg(F.min("row").alias("_first"), F.max("row").alias("_last"), F.sum("_worth").alias("_sum"))
    sheet = bounds.join(totals, by, "full_outer").withColumn("_end", F.coalesce("_last", F.lit(header_row)))
    at = column.get("line_total", max(2, len(fields)))
    summed = F.lit("line_total" in column) & F.col("_first").isNotNull()
    written = {k: F.col(k).isNotNull() for k in TOTALS}
    written["subtotal"] = written["subtotal"] | (F.col("grand_total").isNull() & summed)
    for i, k in enumerate(TOTALS):
        place = sum((F.when(written[b], 1).otherwise(0) for b in TOTALS[:i]), F.lit(0)) + F.col("_end") + 1
        sheet = sheet.withColumn(f"_r_{k}", F.when(written[k], place.cast("int")))
    cell = lambda k: _at(at, F.col(f"_r_{k}"))
    area = F.concat(F.lit("=SUM("), _at(at, F.col("_first")), F.lit(":"), _at(at, F.col("_last")), F.lit(")"))
    taxed = written["tax_amount"] & written["subtotal"] & (F.coalesce("tax_rate", F.lit(0.0)) != 0)
    closes = written["grand_total"] & F.col("subtotal").isNotNull()
    parts = F.concat(F.lit("="), cell("subtotal"), F.when(written["tax_amount"], F.concat(F.lit("+"), cell("tax_amount"))).otherwise(""), F.when(written["discount"], F.concat(F.lit("-ABS("), cell("discount"), F.lit(")"))).otherwise(""))
    formulas = {"subtotal": F.when(written["subtotal"] & summed, area), "tax_amount": F.when(taxed, F.concat(F.lit("="), cell("subtotal"), F.lit("*"), F.col("tax_rate").cast("string"))), "grand_total": F.when(closes, parts)}
    sheet = sheet.withColumn("_v_subtotal", F.when(formulas["subtotal"].isNotNull(), F.col("_sum")).otherwise(F.col("subtotal")))
    sheet = sheet.withColumn("_v_discount", F.col("discount")).withColumn("_v_amount_paid", F.col("amount_paid")).withColumn("_v_tax_amount", F.when(taxed, F.coalesce("_v_subtotal", F.lit(0.0)) * F.col("tax_rate")).otherwise(F.col("tax_amount")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sheet = sheet.withColumn("_v_grand_total", F.when(closes, zero("_v_subtotal") + zero("_v_tax_amount") - F.abs(zero("_v_discount"))).otherwise(F.col("grand_total")))
    below = []
    for k in TOTALS:
        formula = formulas.get(k, F.lit(None).cast("string"))
        label = F.when(F.col(k).isNotNull(), k).otherwise(COMPUTED)
        both = F.array(_cell("label", F.col(f"_r_{k}"), max(1, at - 1), label), _cell("total", F.col(f"_r_{k}"), at, None, formula, F.col(f"_v_{k}"), F.when(formula.isNotNull(), _read(F.col(k)))))
        below.append(F.when(written[k], both).otherwise(F.slice(both, 1, 0)))
    return body.unionByName(sheet.select(*by, F.inline(F.concat(*below))))


def cells_to_review(cells: DataFrame, by: list[str]) -> DataFrame:
    """The flagged cells of a sheet in its order: by, row, column, address, value."""
    return cells.where("review").select(*by, "row", "column", "address", F.coalesce("text", F.format_number("result", 2)).alias("value"))
