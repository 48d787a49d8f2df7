"""Queries on figures, totals, documents, HTML tables and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, documents, html, master, reconcile, repair, rows
from .tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with an ordinal that is unique in the order."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def line_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    items = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("qty"), F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)).otherwise(F.col("p_retailprice")).alias("unit_price"), F.col("l_extendedprice").alias("line_total"))
    found = reconcile.line_agreement(items, ["l_returnflag", "l_linestatus"])
    return found.select("l_returnflag", "l_linestatus", "rows_checked", F.round("agreement", 6).alias("agreement"))


def quantity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third quantity is lost; whole quotients bring it back."""
    li = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_partkey") % 97 + 1.25, 2)
    total = F.round(price * F.col("l_quantity"), 2)
    read = F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("double")).when(F.col("l_orderkey") % 3 == 1, F.col("l_quantity") + 5).otherwise(F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", repair.quantity_from_total(read, price, total).alias("qty"))


def repair_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of five digits, some of which have lost their last digit."""
    li = table(spark, sf_dir, "lineitem")
    price = (F.col("l_partkey") % 9000 + 10007).cast("double")
    items = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("qty"), F.when(F.col("l_orderkey") % 7 == 0, F.floor(price / 10).cast("double")).otherwise(price).alias("unit_price"), (price * F.col("l_quantity")).alias("line_total"))
    return repair.repair_items(items, F.array("qty", "line_total")).select("l_orderkey", "l_linenumber", "l_partkey", "fixed_qty", "fixed_unit_price", "fixed_line_total", "review")


def tax_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price, rate = F.round(F.col("l_partkey") % 50 + 1.5, 2), F.lit(0.25)
    base = F.round(F.col("l_quantity") * price, 2)
    fixed = repair.tax_columns(F.col("l_quantity"), price, rate, F.when(F.col("l_orderkey") % 2 == 0, base), F.when(F.col("l_orderkey") % 3 == 0, base), F.lit(None).cast("double"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", fixed.alias("f")).select("l_orderkey", "l_linenumber", "l_partkey", "f.taxable", "f.vat", "f.total", "f.changed")


def order_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_orderkey").agg(F.round(F.sum(F.round("l_extendedprice", 2)), 2).alias("s"))
    o = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    subtotal = F.when(F.col("o_orderkey") % 4 == 0, F.col("s") + 10).when(F.col("o_orderkey") % 4 == 1, F.col("s")).cast("double")
    totals = o.select(F.col("o_orderkey").alias("doc_id"), subtotal.alias("subtotal"), F.when(F.col("o_orderkey") % 4 < 2, F.lit(5.0)).alias("tax_amount"), F.lit(None).cast("double").alias("discount"), F.when(F.col("o_orderkey") % 4 < 2, F.round(F.col("s") + 5, 2)).when(F.col("o_orderkey") % 4 == 2, F.col("s")).otherwise(F.col("o_totalprice")).alias("grand_total"), F.lit(None).cast("double").alias("tax_rate"))
    found = reconcile.reconcile(li.select(F.col("l_orderkey").alias("doc_id"), F.round("l_extendedprice", 2).alias("line_total")), totals)
    return found.select("doc_id", "summed", "items_ok", "totals_ok")


def _stated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed below the items of each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round("o_totalprice", 2).alias("t"))
    line = lambda pos, label, amount: F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), amount.cast("double").alias("amount"))
    tax = F.lit(15.0)
    plain = F.array(line(1, "Subtotal:", F.col("t")), line(2, "VAT 5%", tax), line(3, "Grand Total", F.round(F.col("t") + tax, 2)))
    double = F.array(line(1, "Total", F.col("t")), line(2, "VAT", tax), line(3, "Total:", F.round(F.col("t") + tax, 2)), line(4, "Amount due", F.round(F.col("t") + tax, 2)))
    twice = F.array(line(1, "Total", F.col("t") + 1), line(2, "Total", F.col("t")), line(3, "Remarks", tax))
    return o.select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, double).otherwise(twice)).alias("s")).select("doc_id", "s.*")


def resolve_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.resolve_totals(_stated_totals(spark, sf_dir))


def totals_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _stated_totals(spark, sf_dir)
    label = F.regexp_replace("label", ":$", "")
    lines = stated.select("doc_id", F.col("pos").alias("line_no"), F.concat(label, F.lit(": USD "), F.format_number("amount", 2)).alias("text"))
    return reconcile.totals_from_lines(lines)


def fill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = F.round("o_totalprice", 2)
    totals = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 < 2, t).alias("subtotal"), F.when(F.col("o_orderkey") % 3 == 1, F.lit(7.5)).alias("tax_amount"), F.when(F.col("o_orderkey") % 3 == 0, F.round(t + 3, 2)).alias("grand_total"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.round("l_extendedprice", 2).alias("line_total"))
    return reconcile.fill_totals(totals, items)


def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    money = F.format_string("%.2f", "l_extendedprice")
    blank = F.lit("")
    kind = F.col("l_orderkey") % 4
    cells = F.when(kind == 0, F.array(F.lit("Grand Total"), blank, blank, money)).when(kind == 1, F.array(F.lit("Section of goods"), blank, blank, blank)).when(kind == 2, F.array(F.concat(F.lit("goods "), "l_linestatus"), F.lit("3"), F.lit("1.50"), money)).otherwise(F.array(blank, F.lit(" "), blank, blank))
    return li.groupBy(reconcile.row_kind(cells).alias("kind"), (kind).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def classify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice words are put before every seventh document, a receipt's before every eleventh."""
    d = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Tax Invoice 7\n"), "text")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Cash Bill. THANK YOU\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", documents.keyword_hits(body, ("tax invoice", "trn")).alias("invoice_words"), documents.keyword_hits(body, ("cash bill", "thank you")).alias("receipt_words"))


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = text.signals(F.col("text"))
    return d.select("doc_id", s["emails"].alias("emails"), s["urls"].alias("urls"))


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line1 = F.concat(F.lit("Order No: "), F.col("o_orderkey").cast("string"), F.lit("    Status: "), "o_orderstatus")
    line2 = F.concat(F.lit("Priority: "), "o_orderpriority", F.lit("\tStatus: later"))
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(line1, line2)).alias("line_no", "text"))
    return documents.labelled_fields(lines)


def party_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    page = F.array(F.lit("Bill to"), F.col("c_name"), F.col("n_name"), F.concat(F.lit("Segment: "), "c_mktsegment"), F.lit("after"))
    lines = c.select(F.col("c_custkey").alias("doc_id"), F.posexplode(page).alias("line_no", "text"))
    return documents.party_blocks(lines, F.lower("text") == "bill to").select("doc_id", "heading", "body")


def master_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    lists = s.where("s_suppkey % 2 = 0").select(F.lit("supplier").alias("field"), F.col("s_name").alias("value")).union(p.where("p_partkey % 2 = 0").select(F.lit("value"), F.col("p_name")))
    values = s.select(F.lit("supplier").alias("field"), F.col("s_name").alias("value")).union(p.select(F.lit("item"), F.col("p_name")))
    return master.exact(values, lists).groupBy("field", "known").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter lost against the list of part names, supplier names with a digit changed
    against that of supplier names."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    lists = p.select(F.lit("part").alias("field"), F.col("p_name").alias("value")).union(s.select(F.lit("supplier"), F.col("s_name")))
    cut = F.col("p_partkey") % F.length("p_name") + 1
    lost = F.concat(F.substring(F.col("p_name"), F.lit(1), (cut - 1).cast("int")), F.substring(F.col("p_name"), (cut + 1).cast("int"), F.length("p_name")))
    values = p.select(F.lit("part").alias("field"), lost.alias("value")).union(s.select(F.lit("supplier"), F.regexp_replace("s_name", r"\d$", "x")))
    return master.fuzzy(values, lists)


def ground_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of an order's items against the prices of the same order's items with even line numbers."""
    li = table(spark, sf_dir, "lineitem").withColumn("value", F.round("l_extendedprice", 2))
    found = master.ground_numbers(li.select("l_orderkey", "value"), li.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("value").alias("seen")), "l_orderkey")
    return found


def _html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per order, its order number merged over all rows, closing tags left out."""
    li = _lines(spark, sf_dir)
    size = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    li = li.withColumn("size", size)
    first = F.when(F.col("n") == 1, F.concat(F.lit("<td rowspan="), F.col("size").cast("string"), F.lit(">A&amp;B "), F.col("l_orderkey").cast("string"))).otherwise("")
    row = F.concat(F.lit("<tr>"), first, F.lit("<td>"), F.col("l_partkey").cast("string"), F.lit("<td>"), F.format_string("%.2f", "l_extendedprice"))
    body = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"]), "").alias("body"))
    head = F.lit("<table><tr><th>Order<th>Part<th>Amount")
    total = F.lit('<tr><td colspan="2">Total<td>1.00</table>')
    return body.select("l_orderkey", F.concat(head, "body", total).alias("html"))


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = html.table_cells(_html_tables(spark, sf_dir), ["l_orderkey"])
    return cells.select("l_orderkey", "r", "c", "text", "spanned", "header")


def _invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice per order: a section, its items, of which some prices lost their last digit, and totals."""
    li = _lines(spark, sf_dir)
    price = F.col("l_partkey") % 9000 + 10007
    read = F.when((F.col("l_partkey") % 4 == 0), F.floor(price / 10)).otherwise(price)
    total = (price * F.col("l_quantity")).cast("double")
    cell = lambda c: F.concat(F.lit("<td>"), c)
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("goods of lot "), F.col("l_partkey").cast("string"))), cell(F.col("l_quantity").cast("int").cast("string")), cell(F.format_string("%d.00", read)), cell(F.format_string("%.2f", total)))
    body = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"]), "").alias("body"), F.sum(total).alias("sum"))
    head = F.lit('<table><tr><th>Description<th>Qty<th>Unit price<th>Amount<tr><td colspan="4">Goods of the first kind')
    foot = F.concat(F.lit('<tr><td colspan="3">Subtotal<td>'), F.format_string("%.2f", "sum"), F.lit('<tr><td colspan="3">VAT<td>10.00<tr><td colspan="3">Grand total<td>'), F.format_string("%.2f", F.col("sum") + 10), F.lit("</table>"))
    return body.select(F.col("l_orderkey").alias("doc_id"), F.concat(head, "body", foot).alias("html"))


def extract_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assembly.extract(_invoice_pages(spark, sf_dir))
    return found.items.join(found.checks.select("doc_id", "items_ok", "totals_ok"), "doc_id").select("doc_id", "item_no", "section", "description", F.col("fixed_qty").alias("qty"), F.col("fixed_unit_price").alias("unit_price"), F.col("fixed_line_total").alias("line_total"), "items_ok", "totals_ok")


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.header_band(html.table_cells(_html_tables(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    page = F.concat(F.lit("before<table><tr><td>"), "p_name", F.lit("</td><td> <b>"), "p_brand", F.lit("</b></td></tr><tr><td>x &lt; y</td></tr></table>after"))
    found = p.select("p_partkey", html.simple_rows(page).alias("rows"), html.blocks(page).alias("blocks"))
    return found.select("p_partkey", F.col("rows")[0][0].alias("name"), F.col("rows")[0][1].alias("brand"), F.col("rows")[1][0].alias("note"), F.size("blocks").alias("n_blocks"), F.col("blocks")[2]["content"].alias("tail"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one file, three lines a page; every second page states the order."""
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source"))
    li = _lines(spark, sf_dir).join(of, "l_orderkey")
    page = F.floor((F.col("n") - 1) / 3)
    pages = li.groupBy("source", "l_orderkey", page.alias("p")).agg(F.count(F.lit(1)).cast("int").alias("n_items"))
    pages = pages.select(F.col("source").cast("string").alias("source"), (F.col("l_orderkey") * 1000 + F.col("p")).alias("page"), F.when(F.col("p") % 2 == 0, F.col("l_orderkey").cast("string")).alias("order_id"), F.array(F.lit("part"), F.lit("amount")).alias("columns"), "n_items")
    return documents.merge_pages(pages).select("source", "page", "doc_no")


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    head = F.when((F.col("n") % 4 == 1), F.concat(F.lit("S"), F.col("n").cast("string")))
    return rows.section_fill(li.select("l_orderkey", "n"), ["l_orderkey"], "n", head)


def sequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers from 11 on; every ninth was misread."""
    li = _lines(spark, sf_dir).select("l_orderkey", "n", F.when((F.col("l_partkey") + F.col("n")) % 9 == 0, 999).otherwise(F.col("n") + 10).cast("int").alias("serial"))
    return rows.sequence_repair(li, ["l_orderkey"], "n", "serial")


QUERIES = {
    "line_agreement": line_agreement, "quantity_repair": quantity_repair, "repair_items": repair_items, "tax_columns": tax_columns, "order_reconciliation": order_reconciliation,
    "resolve_totals": resolve_totals, "totals_from_lines": totals_from_lines, "fill_totals": fill_totals, "row_kinds": row_kinds, "classify_docs": classify_docs,
    "document_signals": document_signals, "labelled_fields": labelled_fields, "party_blocks": party_blocks, "master_exact": master_exact, "fuzzy_master": fuzzy_master,
    "ground_numbers": ground_numbers, "html_cells": html_cells, "extract_invoices": extract_invoices, "html_headings": html_headings, "html_rows": html_rows, "page_text": page_text, "merge_pages": merge_pages,
    "section_fill": section_fill, "sequence_repair": sequence_repair,
}

_N = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"
_NEAR = "abs({a} - ({b})) <= greatest({t}, abs({b}) * 0.005)"

ORACLES = {
    "line_agreement": f"""
        SELECT l_returnflag, l_linestatus, count(*) AS rows_checked, round(avg(CASE WHEN {_NEAR.format(a="l_quantity * pr", b="l_extendedprice", t="0.02")} THEN 1.0 ELSE 0.0 END), 6) AS agreement
        FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN round(l_extendedprice / l_quantity, 2) ELSE p_retailprice END AS pr FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
    "quantity_repair": "SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem",
    "repair_items": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS fixed_qty, CAST(l_partkey % 9000 + 10007 AS DOUBLE) AS fixed_unit_price,
               CAST(l_partkey % 9000 + 10007 AS DOUBLE) * l_quantity AS fixed_line_total, false AS review FROM lineitem""",
    "tax_columns": """
        SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * (l_partkey % 50 + 1.5), 2) AS taxable, round(round(l_quantity * (l_partkey % 50 + 1.5), 2) * 0.25, 2) AS vat,
               round(round(l_quantity * (l_partkey % 50 + 1.5), 2) + round(round(l_quantity * (l_partkey % 50 + 1.5), 2) * 0.25, 2), 2) AS total, true AS changed FROM lineitem""",
    "order_reconciliation": f"""
        WITH s AS (SELECT l_orderkey, round(sum(round(l_extendedprice, 2)), 2) AS s FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS doc_id, s AS summed,
               CASE o_orderkey % 4 WHEN 0 THEN {_NEAR.format(a="s", b="s + 10", t="0.05")} WHEN 1 THEN true WHEN 2 THEN true ELSE {_NEAR.format(a="s", b="o_totalprice", t="0.05")} END AS items_ok,
               CASE o_orderkey % 4 WHEN 0 THEN {_NEAR.format(a="s + 15", b="s + 5", t="0.05")} WHEN 1 THEN true END AS totals_ok
        FROM orders JOIN s ON o_orderkey = l_orderkey""",
    "resolve_totals": """
        SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 2 THEN round(o_totalprice, 2) + 1 ELSE round(o_totalprice, 2) END AS subtotal, CAST(CASE WHEN o_orderkey % 3 < 2 THEN 15.0 END AS DOUBLE) AS tax_amount,
               CASE o_orderkey % 3 WHEN 2 THEN round(o_totalprice, 2) ELSE round(round(o_totalprice, 2) + 15, 2) END AS grand_total,
               CASE WHEN o_orderkey % 3 = 1 THEN round(round(o_totalprice, 2) + 15, 2) END AS amount_paid FROM orders""",
    "totals_from_lines": """
        WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k, round(o_totalprice, 2) AS t FROM orders)
        SELECT doc_id, 'subtotal' AS kind, t AS amount FROM o WHERE k = 0 UNION ALL SELECT doc_id, 'tax_amount', 15.0 FROM o WHERE k < 2
        UNION ALL SELECT doc_id, 'grand_total', CASE k WHEN 0 THEN round(t + 15, 2) WHEN 1 THEN t ELSE round(t + 1, 2) END FROM o
        UNION ALL SELECT doc_id, 'amount_paid', round(t + 15, 2) FROM o WHERE k = 1""",
    "fill_totals": """
        WITH s AS (SELECT l_orderkey, round(sum(round(l_extendedprice, 2)), 2) AS s FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k, round(o_totalprice, 2) AS t FROM orders)
        SELECT doc_id, CASE WHEN k < 2 THEN t END AS subtotal, CASE k WHEN 0 THEN round(round(t + 3, 2) - t, 2) WHEN 1 THEN 7.5 END AS tax_amount,
               CASE k WHEN 0 THEN round(t + 3, 2) WHEN 1 THEN round(t + 7.5, 2) ELSE s END AS grand_total FROM o LEFT JOIN s ON doc_id = l_orderkey""",
    "row_kinds": """
        SELECT CASE l_orderkey % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'section' WHEN 2 THEN 'item' ELSE 'blank' END AS kind, l_orderkey % 4 AS k, count(*) AS n FROM lineitem GROUP BY ALL""",
    "classify_docs": """
        WITH d AS (SELECT doc_id, lower(CASE WHEN doc_id % 7 = 0 THEN 'tax invoice 7 ' ELSE CASE WHEN doc_id % 11 = 0 THEN 'cash bill. thank you ' ELSE '' END END || text) AS t FROM documents)
        SELECT doc_id, CAST(CAST(contains(t, 'tax invoice') AS INTEGER) + CAST(regexp_matches(t, '(^|[^\\p{L}\\p{N}_])trn($|[^\\p{L}\\p{N}_])') AS INTEGER) AS INTEGER) AS invoice_words,
               CAST(CAST(contains(t, 'cash bill') AS INTEGER) + CAST(contains(t, 'thank you') AS INTEGER) AS INTEGER) AS receipt_words FROM d""",
    "document_signals": r"""
        SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS INTEGER) AS emails,
               CAST(len(regexp_extract_all(text, '(?i)https?://|www\.')) AS INTEGER) AS urls FROM documents""",
    "labelled_fields": """
        SELECT o_orderkey AS doc_id, 'order no' AS label, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders
        UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""",
    "party_blocks": "SELECT c_custkey AS doc_id, 'Bill to' AS heading, c_name || ' / ' || n_name AS body FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "master_exact": """
        WITH m AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0)
        SELECT 'supplier' AS field, s_suppkey % 2 = 0 AS known, count(*) AS n FROM supplier GROUP BY 2
        UNION ALL SELECT 'item', p_name IN (SELECT p_name FROM m), count(*) FROM part GROUP BY 2""",
    "ground_numbers": """
        WITH li AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS value, ltrim(replace(printf('%.2f', round(l_extendedprice, 2)), '.', ''), '0') AS d FROM lineitem),
             e AS (SELECT * FROM li WHERE l_linenumber % 2 = 0), q AS (SELECT DISTINCT l_orderkey, value, d FROM li)
        SELECT q.l_orderkey, q.value, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = q.l_orderkey) THEN EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = q.l_orderkey AND contains(e.d, q.d)) END AS grounded FROM q""",
    "html_cells": f"""
        WITH l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n, l_partkey, l_extendedprice FROM lineitem), s AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS k FROM l GROUP BY 1)
        SELECT l_orderkey, 0 AS r, i AS c, (['Order', 'Part', 'Amount'])[i + 1] AS text, false AS spanned, true AS header FROM s, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)
        UNION ALL SELECT l_orderkey, n, 0, 'A&B ' || CAST(l_orderkey AS VARCHAR), n > 1, false FROM l UNION ALL SELECT l_orderkey, n, 1, CAST(l_partkey AS VARCHAR), false, false FROM l
        UNION ALL SELECT l_orderkey, n, 2, printf('%.2f', l_extendedprice), false, false FROM l
        UNION ALL SELECT l_orderkey, k + 1, i, (['Total', '', '1.00'])[i + 1], i = 1, false FROM s, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)""",
    "extract_invoices": f"""
        SELECT l_orderkey AS doc_id, CAST({_N} AS INTEGER) AS item_no, 'Goods of the first kind' AS section, 'goods of lot ' || CAST(l_partkey AS VARCHAR) AS description, l_quantity AS qty,
               CAST(l_partkey % 9000 + 10007 AS DOUBLE) AS unit_price, CAST(l_partkey % 9000 + 10007 AS DOUBLE) * l_quantity AS line_total, true AS items_ok, true AS totals_ok FROM lineitem""",
    "html_headings": """
        WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem)
        SELECT l_orderkey, i AS c, (['Order', 'Part', 'Amount'])[i + 1] AS heading, 1 AS band FROM s, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)""",
    "html_rows": "SELECT p_partkey, p_name AS name, p_brand AS brand, 'x < y' AS note, 3 AS n_blocks, 'after' AS tail FROM part",
    "page_text": r"""
        WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p\s*>|</div\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
             b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM a),
             c AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\r\f\v\x{85}\p{Z}]+', ' ', 'g'), '[ \n]*\n[ \n]*', chr(10), 'g') AS t FROM b)
        SELECT page_id, CAST(length(trim(t, ' ' || chr(10))) AS INTEGER) AS n_chars, sha256(trim(t, ' ' || chr(10))) AS text_sha256 FROM c""",
    "merge_pages": f"""
        WITH l AS (SELECT l_orderkey, {_N} AS n FROM lineitem), p AS (SELECT DISTINCT l_orderkey, CAST(floor((n - 1) / 3) AS BIGINT) AS p FROM l)
        SELECT CAST(o_custkey AS VARCHAR) AS source, l_orderkey * 1000 + p AS page, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS INTEGER) AS doc_no FROM p JOIN orders ON o_orderkey = l_orderkey""",
    "section_fill": f"WITH l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n FROM lineitem) SELECT l_orderkey, n, 'S' || CAST(n - (n - 1) % 4 AS VARCHAR) AS section FROM l",
    "sequence_repair": f"""
        WITH l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n, l_partkey FROM lineitem), m AS (SELECT *, (l_partkey + n) % 9 = 0 AS bad FROM l),
             g AS (SELECT l_orderkey, count(*) AS k, count(*) FILTER (WHERE NOT bad) AS good FROM m GROUP BY 1)
        SELECT l_orderkey, n, CASE WHEN bad AND NOT (good >= 4 AND good >= 0.8 * k) THEN 999 ELSE n + 10 END AS serial, bad AND good >= 4 AND good >= 0.8 * k AS repaired FROM m JOIN g USING (l_orderkey)""",
}
