"""What a run writes: cleaned tables, review queues, invoices, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import CONFIDENCE
from ..operators.rows import filled, pad

#: Order of the labels of an invoice's head and totals.
HEADER_FIELDS = ("supplier", "client_name", "invoice_number", "invoice_date", "due_date", "tax_number", "currency")
TOTAL_FIELDS = ("subtotal", "discount", "tax_amount", "grand_total", "amount_paid")


def review_columns(cells: Column, confidence: Column) -> Column:
    """Numbers (from 0) of the cells that are filled and unsure."""
    unsure = F.transform(F.arrays_zip(cells.alias("t"), confidence.alias("c")), lambda z, i: F.when(filled(z["t"]) & (z["c"] < CONFIDENCE), i))
    return F.array_compact(unsure)


def cleaned_table(rows: DataFrame, width: Column, cells: str = "cells", confidence: str = "confidence", flagged: str = "flagged") -> DataFrame:
    """Rows at the table's width with review columns; a flagged row without any names its first filled cell."""
    rows = rows.withColumn(cells, pad(F.col(cells), width)).withColumn("review", review_columns(F.col(cells), F.col(confidence)))
    first = F.slice(F.array_compact(F.transform(cells, lambda c, i: F.when(filled(c), i))), 1, 1)
    return rows.withColumn("review", F.when((F.size("review") == 0) & F.col(flagged), first).otherwise(F.col("review")))


def write_sheets(rows: DataFrame, path: str) -> None:
    """Cleaned rows as Parquet, a folder per source and sheet."""
    rows.write.mode("overwrite").partitionBy("source", "sheet").parquet(path)


def invoice_tables(invoices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """invoices (doc_id, header: map, items: array, totals: map) -> head, items and totals in fixed orders; a blank total
    falls back on the head's field of that name."""
    def labels(names: tuple[str, ...], value) -> Column:  # noqa: ANN001
        return F.posexplode(F.array(*[F.struct(F.lit(n).alias("field"), value(n).alias("value")) for n in names]))

    head = invoices.select("doc_id", labels(HEADER_FIELDS, lambda n: F.coalesce(F.try_element_at("header", F.lit(n)), F.lit("")))).select("doc_id", F.col("pos"), "col.*")
    total = lambda n: F.coalesce(F.nullif(F.try_element_at("totals", F.lit(n)), F.lit("")), F.try_element_at("header", F.lit(n)), F.lit(""))
    totals = invoices.select("doc_id", labels(TOTAL_FIELDS, total)).select("doc_id", F.col("pos"), "col.*")
    items = invoices.select("doc_id", F.posexplode("items")).select("doc_id", F.col("pos").alias("item_no"), "col.*")
    return head, items, totals


def data_sheet(invoices: DataFrame) -> DataFrame:
    """One row per item with the head's fields repeated."""
    head = [F.try_element_at("header", F.lit(n)).alias(n) for n in HEADER_FIELDS]
    return invoices.select("doc_id", *head, F.posexplode_outer("items").alias("item_no", "item")).select("doc_id", *HEADER_FIELDS, "item_no", "item.*")


def stacked(regions: DataFrame, spacer: int = 1) -> DataFrame:
    """regions (doc_id, region, height) with the row each begins at on a common sheet."""
    before = Window.partitionBy("doc_id").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("first_row", F.coalesce(F.sum(F.col("height") + spacer).over(before), F.lit(0)))


def totals_block(totals: DataFrame, items: DataFrame) -> DataFrame:
    """Printed totals beside computed ones: subtotal from the items, tax from the rate, grand total from its parts. A
    printed total is never replaced; a subtotal is computed only where no grand total is printed."""
    sums = items.groupBy("doc_id").agg(F.round(F.sum("line_total"), 2).alias("_s"))
    both = totals.join(sums, "doc_id", "left")
    subtotal = F.coalesce("subtotal", F.when(F.col("grand_total").isNull(), F.col("_s")))
    tax = F.coalesce("tax_amount", F.round(subtotal * F.col("tax_rate"), 2))
    grand = F.round(subtotal + F.coalesce(tax, F.lit(0.0)) - F.abs(F.coalesce("discount", F.lit(0.0))), 2)
    return both.select("doc_id", F.col("subtotal").alias("printed_subtotal"), F.col("_s").alias("computed_subtotal"), F.col("tax_amount").alias("printed_tax"), tax.alias("computed_tax"), F.col("grand_total").alias("printed_grand"), grand.alias("computed_grand"))


def review_queue(results: DataFrame) -> DataFrame:
    """results (source, review_items: array of structs) -> one row per item to review."""
    return results.select("source", F.explode("review_items").alias("i")).select("source", "i.*")


def review_summary(documents: DataFrame) -> DataFrame:
    """documents (pages: array, items: int, repaired: array, evidence_checked: boolean) -> counts over all."""
    return documents.agg(F.sum(F.size("pages")).alias("pages"), F.sum("items").alias("items"), F.sum(F.size("repaired")).alias("corrections"), F.bool_and("evidence_checked").alias("evidence_on_all"))


def output_name(path: Column) -> Column:
    """A file's base name with eight digits of the SHA-1 of its path."""
    return F.concat(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("_"), F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 8))


def sheet_titles(names: DataFrame, by: list[str], name: str = "name", position: str = "position") -> DataFrame:
    """Titles of at most 31 characters without reserved ones, repeats numbered."""
    safe = F.substring(F.regexp_replace(F.coalesce(name, F.lit("Sheet")), r"[\[\]:*?/\\]", " "), 1, 31)
    named = names.withColumn("title", F.when(F.trim(safe) == "", "Sheet").otherwise(F.trim(safe)))
    turn = F.row_number().over(Window.partitionBy(*by, F.lower("title")).orderBy(position))
    number = F.concat(F.lit("_"), F.col("_n").cast("string"))
    return named.withColumn("_n", turn).withColumn("title", F.when(F.col("_n") == 1, F.col("title")).otherwise(F.concat(F.substring(F.col("title"), F.lit(1), F.lit(31) - F.length(number)), number))).drop("_n")


def cached_value(value: Column) -> Column:
    """A formula's stored result, null where a workbook cannot hold it."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def merged_templates(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` and those of ``new`` whose fingerprint is not known."""
    return known.unionByName(new.dropDuplicates(["fingerprint"]).join(known.select("fingerprint"), "fingerprint", "left_anti").select(*known.columns))
