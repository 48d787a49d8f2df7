"""Queries on columns, fields, layout and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, columns, fields, layout
from .invoices import _N, _lines
from .operations import _words
from .tables import table


def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's prices, in dollars where the line number is odd, else in dirhams or without a mark."""
    li = _lines(spark, sf_dir)
    mark = F.when(F.col("n") % 2 == 1, "$").when(F.col("l_orderkey") % 3 > 0, "AED ").otherwise("")
    cells = li.select("l_suppkey", F.col("l_orderkey").alias("r"), F.col("n").alias("c"), F.concat(mark, F.format_string("%.2f", "l_extendedprice")).alias("text"))
    return columns.currency_vote(cells, ["l_suppkey"])


def decimal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cells = li.select("l_returnflag", F.col("l_orderkey").alias("r"), F.posexplode(F.array(F.format_string("%.2f", "l_extendedprice"), F.format_string("%.3f", "l_discount"), F.col("l_partkey").cast("string"))).alias("c", "text"))
    return columns.decimal_places(cells, ["l_returnflag"])


def isolated_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each supplier's lines as one column; those of every 13th part are read as a letter."""
    li = _lines(spark, sf_dir)
    cells = li.select("l_suppkey", F.concat("l_orderkey", F.lit("/"), "n").alias("r"), F.lit(0).alias("c"), F.when(F.col("l_partkey") % 13 == 0, "l").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("text"))
    return columns.isolated_glyphs(cells, ["l_suppkey"]).select("l_suppkey", "r", "text", "repaired")


def semantic_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per nation: running numbers, mail addresses, telephone numbers and names of its customers."""
    c = table(spark, sf_dir, "customer")
    n = F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)")
    made = F.array(F.col("n").cast("string"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")), F.concat(F.lit("+1 555 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")), F.col("c_name"))
    cells = c.withColumn("n", n).select("c_nationkey", F.col("n").alias("r"), F.posexplode(made).alias("c", "text"))
    heads = c.select("c_nationkey").distinct().select("c_nationkey", F.posexplode(F.array(*[F.lit(f"column_{i}") for i in range(4)])).alias("c", "heading"))
    return columns.semantic_headings(cells, heads, ["c_nationkey"])


def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    made = F.array(F.format_string("%.2f", "l_extendedprice"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.format_string("%.2f", F.col("l_tax") + 0.01), F.col("l_linestatus"))
    cells = li.select("l_returnflag", F.col("l_orderkey").alias("r"), F.posexplode(made).alias("c", "text"))
    heads = F.array(*[F.struct(F.lit(h).alias("heading"), F.lit(r).alias("role")) for h, r in (("weight", "other"), ("lot", "other"), ("vat", "tax"), ("state", "other"))])
    cols = li.select("l_returnflag").distinct().select("l_returnflag", F.posexplode(heads).alias("c", "h")).select("l_returnflag", "c", "h.*")
    return columns.number_columns(cells, cols, ["l_returnflag"])


def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    page = F.concat(F.lit("Customer: "), "c_name", F.lit("\nInvoice No: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nInvoice Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nGrand Total: "), F.format_number("o_totalprice", 2), F.lit(" USD\n"))
    return o.select("o_orderkey", fields.invoice_fields(page).alias("f")).select("o_orderkey", "f.client_name", "f.invoice_number", "f.invoice_date", "f.grand_total", "f.currency", "f.supplier")


def canonical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("Invoice No", "Date", "Due Date", "Sold by", "Bill To", "Consignee Phone", "Shipper Address", "Ship to", "Sender", "VAT No", "Payment Terms", "PO", "Remarks")
    o = table(spark, sf_dir, "orders")
    label = F.get(F.array(*[F.lit(x) for x in labels]), (F.col("o_orderkey") % len(labels)).cast("int"))
    return o.select("o_orderkey", fields.canonical_field(label).alias("field"))


def item_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("A4 paper "), F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" x "))).otherwise(""), F.lit("12.50 USD "), F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", fields.item_values(line).alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "v.*")


def items_reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    items = li.select("l_orderkey", F.col("l_quantity").alias("qty"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), (F.col("l_extendedprice") * F.when(F.col("l_partkey") % 17 == 0, 2.0).otherwise(1.2)).alias("line_total"))
    return fields.items_reliable(items, ["l_orderkey"])


def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    shape = fields.shape_errors(F.array(F.lit("qty"), F.when(F.col("l_partkey") % 5 == 0, "odd").otherwise("other")), F.lit(2), F.lit(3), ("qty",))
    items = li.select("l_orderkey", F.col("l_quantity").alias("qty"), F.lit(2.0).alias("unit_price"), (F.col("l_quantity") * F.when(F.col("l_partkey") % 3 == 0, 3.0).otherwise(2.0)).alias("line_total"), shape.alias("shape"), (F.col("l_partkey") % 2 == 0).alias("grounded"))
    return fields.validate(items, ["l_orderkey"])


def grid_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables on each order's page: a totals box, the items, their continuation, a note."""
    o = table(spark, sf_dir, "orders")
    row = lambda *c: F.array(*[F.lit(x) for x in c])
    heads = F.array(F.lit("Item"), F.lit("Qty"), F.lit("Amount"))
    none = F.array().cast("array<string>")

    def grid(idx: int, height, width: int, headings, body):  # noqa: ANN001, ANN202
        return F.struct(F.lit(idx).alias("idx"), height.cast("int").alias("height"), F.lit(width).alias("width"), headings.alias("headings"), body.alias("rows"))

    n = F.col("o_orderkey") % 5 + 3
    grids = F.array(grid(0, F.lit(2), 2, none, F.array(row("Total", "5.00"), row("VAT", "1.00"))), grid(1, n, 3, heads, F.array(row("desk", "1", "5.00"))), grid(2, F.lit(2), 3, F.when(F.col("o_orderkey") % 2 == 0, none).otherwise(heads), F.array(row("lamp", "1", "5.00"))), grid(3, F.lit(2), 1, none, F.array(row("note"))))
    pages = o.select(F.col("o_orderkey").alias("page"), F.explode(grids).alias("g")).select("page", "g.*")
    return fields.grid_kinds(pages).select("page", "idx", "kind")


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    page = F.array(F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Born 01/02/1990 in "), "n_name"), F.concat(F.lit("Balance . "), F.format_string("%.2f", F.abs("c_acctbal"))), F.lit("Phone: +1 555 0100200"))
    lines = c.select(F.col("c_custkey").alias("doc_id"), F.posexplode(page).alias("line_no", "text")).where("line_no < 3 OR doc_id % 2 = 0").where("line_no > 0 OR doc_id % 3 > 0")
    specs = spark.createDataFrame([("name", "^name", "text"), ("born", "^born", "date"), ("balance", "^balance", "number"), ("phone", "^phone", "phone")], "field string, pattern string, kind string")
    return fields.form_fields(lines, specs)


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per order: two labels with their values, the second far to the right."""
    o = table(spark, sf_dir, "orders")
    word = lambda x, t: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(x + 30)).alias("x1"), t.alias("text"))
    words = F.array(word(0, F.lit("Order")), word(35, F.lit("No:")), word(70, F.col("o_orderkey").cast("string")), word(105, F.lit("of")), word(300, F.lit("Order")), word(335, F.lit("Status:")), word(370, F.col("o_orderstatus")))
    rows = o.select(F.col("o_orderkey").alias("page"), F.lit(0).alias("line"), F.explode(words).alias("w")).select("page", "line", "w.*")
    return layout.label_values(rows, ["page"])


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of orders' pages, with a wide hole below every fourth line."""
    w = _words(spark, sf_dir).withColumn("line", F.col("n") - 1)
    drop = F.floor(F.col("line") / 4) * 60.0
    lines = w.groupBy("l_orderkey", "line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    boxes = w.select("l_orderkey", "line", F.col("word_idx").alias("box_idx"), "x0", "x1")
    return layout.group_blocks(lines.withColumn("y0", F.col("y0") + drop).withColumn("y1", F.col("y1") + drop), boxes, ["l_orderkey"]).select("l_orderkey", "line", "block")


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of orders' pages, a speck of dust on each, as tables."""
    box = lambda i, t, conf, x0, x1: F.struct(i.cast("long").alias("word_idx"), t.alias("text"), F.lit(conf).alias("conf"), x0.alias("x0"), x1.alias("x1"), "y0", "y1")
    word = box(F.col("word_idx"), F.col("text"), 90.0, F.col("x0"), F.col("x1"))
    dust = box(F.col("word_idx") + 100000, F.lit("."), 5.0, F.col("x1"), F.col("x1") + 40)
    w = _words(spark, sf_dir).select("l_orderkey", F.inline(F.when(F.col("word_idx") % 7 == 0, F.array(word, dust)).otherwise(F.array(word))))
    cells, _ = layout.tables_of_words(w, ["l_orderkey"])
    return cells.select("l_orderkey", "block", "line", "column_idx", "text", "conf")


def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' pages without rules: part, supplier and amount below their headings; part and supplier are read as one word
    with a bar on every third line."""
    li = _lines(spark, sf_dir)
    word = lambda k, x, width, t: F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x0"), F.lit(float(x + width)).alias("x1"), t.cast("string").alias("text"))
    apart = F.array(word(0, 10, 60, F.col("l_partkey")), word(1, 150, 60, F.col("l_suppkey")), word(2, 300, 60, F.format_string("%.2f", "l_extendedprice")))
    barred = F.array(word(0, 10, 260, F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))), word(2, 300, 60, F.format_string("%.2f", "l_extendedprice")))
    head = F.array(word(0, 10, 60, F.lit("Part")), word(1, 150, 60, F.lit("Supplier")), word(2, 300, 60, F.lit("Amount")))
    heads = li.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("n"), F.explode(head).alias("w"))
    body = li.select("l_orderkey", "n", F.explode(F.when(F.col("n") % 3 == 0, barred).otherwise(apart)).alias("w"))
    words = body.unionByName(heads).select("l_orderkey", (F.col("n") * 3 + F.col("w.k")).alias("word_idx"), "w.text", "w.x0", "w.x1", (F.col("n") * 30.0).alias("y0"), (F.col("n") * 30.0 + 12).alias("y1"))
    return layout.aligned_table(words, ["l_orderkey"])


def region_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    region = lambda i, kind, t, y: F.struct(F.lit(i).alias("region"), F.lit(kind).alias("kind"), t.alias("text"), F.lit(float(y)).alias("y0"), F.lit(float(y + 10)).alias("y1"), F.lit(10.0).alias("line_height"))
    regions = F.array(region(0, "text", F.lit("A letter"), 0), region(1, "text", F.concat(F.lit("Items of "), F.col("o_orderkey").cast("string")), 200), region(2, "table", F.lit(""), 215), region(3, "text", F.lit("Far above"), 300), region(4, "table", F.lit(""), 400))
    rows = o.select(F.col("o_orderkey").alias("page"), F.explode(regions).alias("r")).select("page", "r.*")
    return layout.attach_titles(rows, ["page"]).select("page", "region", "title")


def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines of orders' pages: four across, and as many down as the order has items, one too near."""
    li = _lines(spark, sf_dir)
    across = li.select("l_orderkey").distinct().select("l_orderkey", F.lit("x").alias("axis"), F.explode(F.array(*[F.lit(float(x)) for x in (0, 50, 54, 120, 200)])).alias("at"))
    down = li.select("l_orderkey", F.lit("y").alias("axis"), (F.col("n") * 20.0).alias("at"))
    return layout.grid_cells(across.union(down), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cells"))


def centroid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.centroid_lines(_words(spark, sf_dir).drop("n", "k"), ["l_orderkey"]).select("l_orderkey", "word_idx", "line")


def serial_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item numbers down a page, with some other numbers between them."""
    li = _lines(spark, sf_dir)
    number = F.when(F.col("l_partkey") % 4 == 0, F.lit(90000)).otherwise(F.col("n"))
    words = li.select("l_orderkey", F.col("n").alias("word_idx"), number.cast("long").alias("value"), (F.col("n") * 20.0).alias("y0"), F.lit(80.0).alias("conf"))
    return layout.serial_chain(words, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def reading_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a cell: ship modes of the lines of an order, as sure as their part number says."""
    li = table(spark, sf_dir, "lineitem")
    found = columns.alternatives(li.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_partkey") % 1000).cast("double").alias("conf")), ["l_orderkey"])
    return found.select("l_orderkey", F.array_join(F.transform("alternatives", lambda a: a["text"]), "|").alias("texts"), F.col("alternatives")[0]["conf"].alias("best"))


def cell_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cells = li.select("l_suppkey", F.when(F.col("l_partkey") % 6 == 0, " ").otherwise("x").alias("text"), (F.col("l_partkey") % 110 - 10).cast("double").alias("conf"))
    return columns.mean_confidence(cells, ["l_suppkey"])


def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("status", F.col("o_orderstatus")), ("number", F.col("o_orderkey").cast("string")), ("copy", F.lower("o_orderstatus")), ("customer", F.col("o_custkey").cast("string")), ("blank", F.lit(" ")))])
    flat = o.where("o_orderkey <> o_custkey").select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.*")
    return columns.header_columns(flat, ["o_orderkey"], ("number", "customer"))


def account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts; events of users change their plans."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("email"), F.lit("free").alias("plan_slug"), F.lit(True).alias("plan_active"), F.lit(None).cast("long").alias("activated_at"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("plan_slug"), (F.col("event_id") % 3 > 0).alias("plan_active"), F.col("event_id").alias("at"))
    return accounts.upsert_accounts(c, e)


def lead_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.get(F.array(*[F.lit(s) for s in ("new", "contacted", "lost", "converted")]), (F.col("event_id") % 11 % 4).cast("int"))
    return accounts.lead_states(e.select(F.col("user_id").alias("lead_id"), F.col("event_id").alias("at"), status.alias("status"), F.when(F.col("user_id") % 9 == 0, "x").otherwise("").alias("honeypot")))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    reads = li.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("items"), (F.col("l_partkey") % 3 > 0).alias("priced"), (F.col("l_partkey") % 7 > 0).alias("adds_up"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.lit(2.5).alias("prompt_price"), F.lit(10.0).alias("completion_price"))
    return accounts.model_scores(reads).select("model", "items", F.round("priced", 6).alias("priced"), F.round("adds_up", 6).alias("adds_up"), F.round("cost", 6).alias("cost"))


QUERIES = {
    "currency_vote": currency_vote, "decimal_places": decimal_places, "isolated_glyphs": isolated_glyphs, "semantic_headings": semantic_headings, "number_columns": number_columns,
    "invoice_fields": invoice_fields, "canonical_fields": canonical_fields, "item_values": item_values, "items_reliable": items_reliable, "validation_gates": validation_gates,
    "grid_kinds": grid_kinds, "form_fields": form_fields, "label_values": label_values, "line_blocks": line_blocks, "layout_tables": layout_tables, "aligned_tables": aligned_tables, "region_titles": region_titles, "ruled_cells": ruled_cells,
    "centroid_lines": centroid_lines, "serial_chains": serial_chains, "reading_alternatives": reading_alternatives, "cell_confidence": cell_confidence, "header_columns": header_columns,
    "account_changes": account_changes, "lead_states": lead_states, "model_scores": model_scores,
}

_L = f"l AS (SELECT *, CAST({_N} AS INTEGER) AS n FROM lineitem)"
_W = "l AS (SELECT l_orderkey, CAST(" + _N + " AS INTEGER) AS n FROM lineitem), w AS (SELECT l_orderkey, n, k, n * 3 + k AS word_idx FROM l, (SELECT CAST(unnest(range(3)) AS INTEGER) AS k))"
_FIELDS = "['invoice_number','invoice_date','due_date','supplier','client_name','consignee_phone','shipper_address','consignee','shipper','tax_number','payment_terms','purchase_order',NULL]"

ORACLES = {
    "currency_vote": f"""
        WITH {_L}, m AS (SELECT l_suppkey, l_orderkey, n, CASE WHEN n % 2 = 1 THEN 'USD' WHEN l_orderkey % 3 > 0 THEN 'AED' END AS c FROM l),
             q AS (SELECT l_suppkey, c, count(*) AS num, min(l_orderkey * 1000 + n) AS first_at FROM m WHERE c IS NOT NULL GROUP BY ALL)
        SELECT l_suppkey, c AS currency FROM q QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY num DESC, first_at) = 1""",
    "decimal_places": "SELECT l_returnflag, i AS c, i + 2 AS places FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS i)",
    "isolated_glyphs": f"""
        WITH {_L}, g AS (SELECT l_suppkey, count(*) AS k, count(*) FILTER (WHERE l_partkey % 13 > 0) AS good FROM l GROUP BY 1)
        SELECT l_suppkey, CAST(l_orderkey AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS r, CASE WHEN l_partkey % 13 > 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN good >= 3 AND good >= 0.7 * k THEN '1' ELSE 'l' END AS text,
               l_partkey % 13 = 0 AND good >= 3 AND good >= 0.7 * k AS repaired FROM l JOIN g USING (l_suppkey)""",
    "semantic_headings": """
        WITH n AS (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1)
        SELECT c_nationkey, i AS c, CASE i WHEN 0 THEN CASE WHEN k >= 3 THEN 'row_number' ELSE 'column_0' END WHEN 1 THEN 'email' WHEN 2 THEN 'phone' ELSE 'column_3' END AS heading FROM n, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)""",
    "number_columns": """
        SELECT l_returnflag, i AS c, (['weight', 'lot', 'vat', 'state'])[i + 1] AS heading, (['other', 'other', 'tax', 'other'])[i + 1] AS role, i = 0 AS as_number, i = 2 AS percent
        FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)""",
    "invoice_fields": """
        SELECT o_orderkey, c_name AS client_name, 'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, format('{:,.2f}', o_totalprice) AS grand_total, 'USD' AS currency, '' AS supplier
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "canonical_fields": f"SELECT o_orderkey, ({_FIELDS})[o_orderkey % 13 + 1] AS field FROM orders",
    "item_values": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity ELSE 1.0 END AS qty, CAST(12.5 AS DOUBLE) AS unit_price, round(l_extendedprice, 2) AS total FROM lineitem",
    "items_reliable": "SELECT l_orderkey, bool_or(l_partkey % 10 > 0) AND NOT bool_or(l_partkey % 10 > 0 AND l_partkey % 17 = 0) AS reliable FROM lineitem GROUP BY 1",
    "validation_gates": """
        SELECT l_orderkey, count(*) FILTER (WHERE l_partkey % 5 = 0) AS shape_errors, count(*) FILTER (WHERE l_partkey % 3 = 0) AS arithmetic_errors, count(*) FILTER (WHERE l_partkey % 2 = 1) AS ungrounded,
               NOT bool_or(l_partkey % 5 = 0 OR l_partkey % 3 = 0) AS passed FROM lineitem GROUP BY 1""",
    "grid_kinds": "SELECT o_orderkey AS page, i AS idx, (['totals', 'items', 'more', 'other'])[i + 1] AS kind FROM orders, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)",
    "form_fields": """
        WITH c AS (SELECT c_custkey AS doc_id, c_name, abs(c_acctbal) AS b, c_custkey % 3 > 0 AS named, c_custkey % 2 = 0 AS phoned FROM customer), d AS (SELECT * FROM c WHERE named OR phoned)
        SELECT doc_id, 'name' AS field, c_name AS value FROM d WHERE named UNION ALL SELECT doc_id, 'born', '1990-02-01' FROM d UNION ALL SELECT doc_id, 'balance', printf('%.2f', b) FROM d
        UNION ALL SELECT doc_id, 'phone', '+15550100200' FROM d WHERE phoned""",
    "label_values": "SELECT o_orderkey AS page, 0 AS line, 'Order No' AS label, CAST(o_orderkey AS VARCHAR) || ' of' AS value FROM orders UNION ALL SELECT o_orderkey, 0, 'Order Status', o_orderstatus FROM orders",
    "line_blocks": f"WITH {_W} SELECT DISTINCT l_orderkey, n - 1 AS line, CAST(floor((n - 1) / 4) AS INTEGER) AS block FROM w",
    "layout_tables": f"""
        WITH l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n, l_partkey, l_suppkey, l_linenumber FROM lineitem)
        SELECT l_orderkey, 0 AS block, n - 1 AS line, i AS column_idx, CASE i WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) END AS text, CAST(90.0 AS DOUBLE) AS conf
        FROM l, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)""",
    "aligned_tables": f"""
        WITH l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n, l_partkey, l_suppkey, l_extendedprice FROM lineitem), i AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)
        SELECT l_orderkey, n AS line, i AS column_idx, CASE i WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE printf('%.2f', l_extendedprice) END AS text FROM l, i
        UNION ALL SELECT l_orderkey, 0, i, (['Part', 'Supplier', 'Amount'])[i + 1] FROM (SELECT DISTINCT l_orderkey FROM lineitem), i""",
    "serial_chains": f"""
        WITH {_L}, g AS (SELECT l_orderkey, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS island FROM l WHERE l_partkey % 4 > 0),
             r AS (SELECT l_orderkey, count(*) AS n FROM g GROUP BY l_orderkey, island UNION ALL SELECT DISTINCT l_orderkey, 1 FROM l)
        SELECT l_orderkey, max(n) AS n FROM r GROUP BY 1""",
    "region_titles": """
        SELECT o_orderkey AS page, i AS region, CASE WHEN i = 2 THEN 'Items of ' || CAST(o_orderkey AS VARCHAR) END AS title FROM orders, (SELECT CAST(unnest([0, 2, 3, 4]) AS INTEGER) AS i)""",
    "ruled_cells": "SELECT l_orderkey, 3 * (count(*) - 1) AS cells FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "centroid_lines": f"WITH {_W} SELECT l_orderkey, word_idx, n - 1 AS line FROM w",
    "reading_alternatives": """
        WITH b AS (SELECT l_orderkey, l_returnflag || l_linestatus AS t, CAST(max(l_partkey % 1000) AS DOUBLE) AS c FROM lineitem GROUP BY ALL),
             k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, t) AS k FROM b)
        SELECT l_orderkey, string_agg(t, '|' ORDER BY k) AS texts, max(c) AS best FROM k WHERE k <= 3 GROUP BY 1""",
    "cell_confidence": "SELECT l_suppkey, count(*) AS cells, round(avg(CASE WHEN l_partkey % 110 >= 10 THEN l_partkey % 110 - 10 END), 1) AS confidence FROM lineitem WHERE l_partkey % 6 > 0 GROUP BY 1",
    "header_columns": """
        WITH o AS (SELECT * FROM orders WHERE o_orderkey <> o_custkey)
        SELECT o_orderkey, 0 AS position, 'number' AS key, CAST(o_orderkey AS VARCHAR) AS value FROM o UNION ALL SELECT o_orderkey, 1, 'customer', CAST(o_custkey AS VARCHAR) FROM o UNION ALL SELECT o_orderkey, 2, 'copy', lower(o_orderstatus) FROM o""",
    "account_changes": """
        WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS email, CASE WHEN event_id % 4 > 0 THEN event_type END AS slug, event_id % 3 > 0 AS act, event_id FROM events),
             l AS (SELECT email, arg_max(coalesce(slug, '-'), event_id) AS slug, arg_max(act, event_id) AS act, min(event_id) FILTER (WHERE act AND slug IS NOT NULL) AS at FROM e GROUP BY 1),
             c AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS email FROM customer)
        SELECT coalesce(c.email, l.email) AS email, CASE WHEN l.email IS NULL THEN 'free' ELSE nullif(l.slug, '-') END AS plan_slug, CASE WHEN l.email IS NULL THEN true ELSE l.act AND l.slug <> '-' END AS plan_active, l.at AS activated_at
        FROM c FULL JOIN l ON c.email = l.email""",
    "lead_states": """
        WITH e AS (SELECT user_id AS lead_id, event_id, (['new', 'contacted', 'lost', 'converted'])[event_id % 11 % 4 + 1] AS s FROM events WHERE user_id % 9 > 0)
        SELECT lead_id, CASE WHEN bool_or(s = 'converted') THEN 'converted' ELSE arg_max(s, event_id) END AS status, min(event_id) FILTER (WHERE s = 'contacted') AS contacted_at FROM e GROUP BY 1""",
    "model_scores": """
        SELECT l_returnflag AS model, CAST(sum(l_linenumber) AS BIGINT) AS items, round(avg(CASE WHEN l_partkey % 3 > 0 THEN 1.0 ELSE 0.0 END), 6) AS priced, round(avg(CASE WHEN l_partkey % 7 > 0 THEN 1.0 ELSE 0.0 END), 6) AS adds_up,
               round(sum((l_partkey * 2.5 + l_suppkey * 10.0) / 1e6), 6) AS cost FROM lineitem GROUP BY 1""",
}
