"""Queries on text and number helpers, merged evidence, files written and read back, sheets and states of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import accounts, columns, documents, fields, geometry, headers, jobs, layout, rows
from ..session import scratch
from ..sources import files, sinks
from .invoices import _N, _lines
from .operations import _words
from .tables import table


def _turn(key: str, *choices) -> Column:  # noqa: ANN002
    """The choice that a key's remainder tells."""
    out = None
    for i, choice in enumerate(choices):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        out = F.when(F.col(key) % len(choices) == i, value) if out is None else out.when(F.col(key) % len(choices) == i, value)
    return out


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and figures as an OCR engine gives them."""
    p = table(spark, sf_dir, "part")
    dirty = F.concat(F.lit(" ~|"), "p_name", F.lit("  •"), "p_brand", F.lit(" _-,"))
    figure = _turn("p_partkey", F.format_string("%.2f", "p_retailprice"), F.concat(F.col("p_size").cast("string"), F.lit("O")), F.col("p_name"), F.lit("12/05/2020"))
    mixed = _turn("p_partkey", F.concat(F.lit("فاتورة "), "p_brand"), F.col("p_name"), F.col("p_type"))
    name = _turn("p_partkey", F.col("p_name"), F.concat(F.lit("("), "p_name"), F.concat("p_name", F.lit(" [x")))
    return p.select("p_partkey", text.tidy_ocr(dirty).alias("tidy"), text.looks_numeric(figure).alias("numeric"), text.direction(mixed).alias("direction"), text.is_name(name).alias("named"))


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = _turn("c_custkey", "usd", "EUR", "SAR", F.lit(None).cast("string"))
    phone = F.when(F.col("c_custkey") % 5 == 0, "12-34").otherwise(F.concat(F.lit("(+20) "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    words = F.array(F.struct(F.lit(30.0).alias("x0"), F.lit("end").alias("text")), F.struct(F.lit(10.0).alias("x0"), F.col("c_name").alias("text")), F.struct(F.lit(20.0).alias("x0"), F.lit(" of ").alias("text")))
    return c.select(
        "c_custkey", text.currency_format(code).alias("format"), text.safe_name(F.concat(F.lit("C:\\tmp/"), "c_name", F.lit("?.pdf"))).alias("file"), text.phone_digits(phone).alias("phone"),
        text.fingerprint(F.concat(F.lit(" "), "c_name", F.lit("  \n"), "c_mktsegment")).alias("fingerprint"), text.join_words(words, F.col("c_custkey") % 2 == 1).alias("joined"),
    )


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir).withColumn("price", F.round("l_extendedprice", 2))
    us = F.format_number("price", 2)
    eu = F.translate(F.translate(F.translate(us, ",", "~"), ".", ","), "~", ".")
    line = F.col("l_linenumber").cast("string")
    return li.select(
        "l_orderkey", "n", numbers.normalize_number(F.when((F.col("l_orderkey") % 2 == 0) | (F.col("price") < 1000), us).otherwise(eu)).alias("plain"),
        numbers.number_in(F.concat(F.lit("about "), us, F.lit(" or so"))).alias("found"), numbers.number_after_label(F.concat(F.lit("Total: "), F.translate(us, ",", " "))).alias("labelled"),
        F.round(numbers.percent_aware(F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))["num"], 6).alias("share"),
        numbers.ocr_number(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Qty "), line)).otherwise(F.concat(line, F.lit(" of 7")))).alias("one"),
        numbers.plain_number(F.when(F.col("l_linenumber") % 3 == 0, F.lpad(F.col("l_orderkey").cast("string"), 9, "1")).otherwise(line)).alias("bare"),
    )


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    later = day + F.make_interval(secs=(F.col("o_orderkey") % 100 - 20).cast("decimal(18,6)"))
    return o.select("o_orderkey", text.is_date_field(_turn("o_orderkey", "Ship Date", "Order", "تاريخ")).alias("is_date"), dates.month_key(day).alias("month"), dates.elapsed_ms(day, later).alias("ms"))


def misread_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with a letter misread, or of no known kind."""
    shown = _turn("p_partkey", " Quantlty ", "Suppller", "Descrlption", "zzqx wwvk")
    named = headers.canonical_headers(table(spark, sf_dir, "part").select("p_partkey", shown.alias("heading")), "heading")
    return named.select("p_partkey", "canonical")


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as evidence on fields: the best precedence, the first and the last."""
    o = table(spark, sf_dir, "orders")
    found = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"))).alias("value"), (F.col("o_orderkey") % 3).alias("prio"), "o_orderkey")
    best = documents.by_precedence(found, ["doc_id"]).withColumnRenamed("value", "best")
    first = documents.first_wins(found, ["doc_id"], "o_orderkey").withColumnRenamed("value", "first")
    last = documents.last_wins(found, ["doc_id"], "o_orderkey").withColumnRenamed("value", "last")
    return best.join(first, ["doc_id", "key"]).join(last, ["doc_id", "key"])


def evidence_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    read = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    placed = F.create_map(F.lit("name"), F.lower("c_name"), F.lit("segment"), F.lit("placed"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    both = c.select("c_custkey", fields.overlay(read, placed, ("segment",)).alias("m"))
    return both.select("c_custkey", *[F.col("m")[k].alias(k) for k in ("name", "segment", "nation")])


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of an order's items: of each field the best rank's, where it has one."""
    li = _lines(spark, sf_dir)
    read = F.create_map(F.lit("part"), F.when(F.col("n") % 2 == 0, "").otherwise(F.col("l_partkey").cast("string")), F.lit("line"), F.col("n").cast("string"))
    found = fields.best_candidate(li.select("l_orderkey", F.col("n").alias("rank"), read.alias("fields")), ["l_orderkey"])
    return found.select("l_orderkey", F.try_element_at("fields", F.lit("part")).alias("part"), F.try_element_at("fields", F.lit("line")).alias("line"))


def details_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of details boxes: "label: value" cells, or a label beside its value."""
    o = table(spark, sf_dir, "orders")
    cells = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("Order no: "), F.col("o_orderkey").cast("string")), F.lit(""), F.concat(F.lit(" Status : "), "o_orderstatus"))).otherwise(F.array(F.lit("Priority:"), F.col("o_orderpriority")))
    return o.select("o_orderkey", F.explode(fields.field_pairs(cells)).alias("p")).select("o_orderkey", "p.label", "p.value")


def labels_over_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    grid = F.array(F.array(F.lit("Order"), F.lit("Status"), F.lit("Priority")), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise("")))
    return fields.label_rows(o.select("o_orderkey", F.posexplode(grid).alias("row_idx", "cells")), ["o_orderkey"])


def value_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    labels = w.where("k = 0 AND n % 2 = 1").select("l_orderkey", F.col("word_idx").alias("label_idx"), "x0", "y1")
    return geometry.value_below(labels, w.select("l_orderkey", "word_idx", "text", "x0", "y0"), ["l_orderkey"]).select("l_orderkey", "label_idx", "word_idx", "value")


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word read twice, the second time a little aside and less surely."""
    w = _words(spark, sf_dir).select("l_orderkey", "word_idx", "text", "x0", "x1", "y0", "y1")
    twice = w.select("*", F.lit(90.0).alias("conf")).union(w.select("l_orderkey", F.col("word_idx") + 100_000, F.concat("text", F.lit("?")), F.col("x0") + 2, F.col("x1") + 2, "y0", "y1", F.lit(50.0)))
    kept = geometry.suppress(twice, ["l_orderkey"])
    return kept.select("l_orderkey", "word_idx", "text", F.array_join("alternatives", ",").alias("others"))


def page_mastheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = d.select("doc_id", F.lit(0).alias("section"), F.when(F.col("doc_id") % 4 == 0, "table").otherwise("text").alias("kind"), "text")
    return layout.masthead(first.union(d.select("doc_id", F.lit(1), F.lit("text"), F.lit("later"))), ["doc_id"])


def item_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per customer: titles, then headings of items."""
    c = table(spark, sf_dir, "customer")
    title = F.array(F.struct(F.lit(0).alias("i"), F.array(F.lit("Report"), F.lit(""), F.lit("")).alias("cells")))
    rest = F.array(F.struct((F.col("c_custkey") % 7 + 1).cast("int").alias("i"), F.array(F.lit("Description"), F.lit("Qty"), F.lit("Unit price")).alias("cells")), F.struct(F.lit(9).alias("i"), F.array(F.lit("bolt"), F.lit("2"), F.lit("3.50")).alias("cells")))
    sheet = c.select("c_custkey", F.explode(F.concat(title, rest)).alias("r")).select("c_custkey", F.col("r.i").alias("row_idx"), "r.cells")
    return columns.item_header(sheet, ["c_custkey"])


def amount_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    names = F.array(F.lit("Item"), F.lit("Qty"), F.lit("Taxable"), _turn("c_custkey", "VAT", "Tax rate"), F.lit("Total"), F.lit("Total"))
    return columns.amount_columns(c.select("c_custkey", F.posexplode(names).alias("c", "heading")), ["c_custkey"])


def planned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed headings with an unnamed column, which some customers fill, and a field that no heading names."""
    c = table(spark, sf_dir, "customer")
    printed = c.select("c_custkey", F.posexplode(F.array(F.lit("Name"), F.lit("column_2"), F.lit("Balance"))).alias("c", "heading"))
    items = c.select("c_custkey", F.lit(1).alias("item"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("column_2"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(" "), F.lit("Segment"), F.col("c_mktsegment"))).alias("key", "value"))
    return columns.plan_columns(printed, items, ["c_custkey"])


def unsure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    sure = (F.col("l_partkey") % 60).cast("double")
    return li.select("l_orderkey", "n", columns.blank_unsure(F.col("l_partkey").cast("string"), sure, F.col("l_linenumber") % 2 == 1).alias("cell"))


def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("p"), (F.col("c_custkey") % 30).cast("string")).alias("plan_slug"))
    plans = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_regionkey").cast("double").alias("price"), (F.col("n_nationkey") % 3 > 0).alias("active"))
    return accounts.with_plan(accounts.known_plan(users, plans), plans)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = _turn("o_orderkey", "queued", "processing", "completed", "failed")
    message = _turn("o_orderkey", "1: no page could be read", "gone", "upstream busy", "the fallback could not either", "odd answer", "no page could be read")
    error = F.when(F.col("o_orderkey") % 4 == 1, "FileNotFoundError").otherwise("AIFailed")
    gone = accounts.reader_gone(_turn("o_orderkey", "200", "402", "429", "400", "503").cast("int"), message)
    warnings = accounts.capped_warnings(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: i.cast("string")), most=4)
    chosen = accounts.first_that_passes((F.lit("small"), F.col("o_orderkey") % 2 == 0), (F.lit("large"), F.col("o_orderkey") % 3 == 0))
    return o.select("o_orderkey", jobs.status_label(state, F.col("o_orderkey") % 3, F.col("o_orderkey") % 2).alias("label"), accounts.cancelled(state).alias("after_cancel"), accounts.failure_code(message, error, gone).alias("code"), F.array_join(warnings, ",").alias("warnings"), chosen.alias("model"))


def stage_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("ms"), F.col("event_id").alias("ts"), "event_id")
    return jobs.upsert_stages(e)


def best_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    name = F.concat(F.when(F.col("n") % 2 == 0, "GOODS ").otherwise("goods "), (F.col("l_partkey") % 3).cast("string"))
    found = jobs.dedupe_best(li.select("l_orderkey", name.alias("description"), F.col("l_quantity").alias("conf"), F.col("n").alias("item_no")), ["l_orderkey"])
    return found.select("l_orderkey", F.lower("description").alias("description"), "conf", "item_no")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in a model's answer, read by any of a key's names."""
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("Sure: {\"name\": \""), "p_name", F.lit("\", "), _turn("p_partkey", "\"qty\"", "\"quantity\""), F.lit(": "), F.col("p_size").cast("string"), F.lit(",} done"))
    body = text.json_of(said)
    return p.select("p_partkey", F.get_json_object(body, "$.name").alias("name"), files.first_key(body, "qty", "quantity").alias("qty"))


def sniffed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the first bytes of several kinds of files."""
    d = table(spark, sf_dir, "documents")
    head = _turn("doc_id", "255044462D", "89504E470D0A", "FFD8FFE0", "504B0304", "00010203", "613B620A313B")
    return d.select("doc_id", files.sniff(F.concat(F.unhex(head), F.encode(F.coalesce(F.substring("text", 1, 3), F.lit("")), "UTF-8"))).alias("kind"))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV files, found, routed and read back as sheets."""
    folder = scratch(spark, "csv")
    s = table(spark, sf_dir, "supplier")
    s.select(F.col("s_suppkey").alias("Code"), F.concat(F.lit('Big "'), "s_name", F.lit('", Inc')).alias("Supplier"), F.col("s_nationkey").alias("Nation")).write.option("header", True).option("escape", '"').csv(folder)
    found = files.files(spark, folder)
    read = files.sheets(found.where(files.route(F.col("suffix")) == "tabular")).where("row_idx > 0")
    return read.select(F.col("cells")[0].cast("long").alias("s_suppkey"), F.col("cells")[1].alias("supplier"), F.col("cells")[2].cast("int").alias("nation"))


def csv_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists from CSV files of suppliers, and the same lines split over tasks."""
    folder = scratch(spark, "lists")
    table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("  Ltd")).alias("Supplier")).write.option("header", True).csv(folder)
    lists = files.master(files.sheets(files.files(spark, folder)))
    lines = files.csv_lines(spark, folder).where("value <> 'Supplier'").select(F.lit("line").alias("field"), F.col("cells")[0].alias("value"))
    return lists.union(lines)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as printed lines of text files, read back as table rows."""
    folder = scratch(spark, "text")
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("No  "), F.col("o_orderkey").cast("string"), F.lit("   "), "o_orderstatus")).otherwise(F.concat(F.lit("No\t"), F.col("o_orderkey").cast("string"), F.lit("\t"), "o_orderstatus"))
    o.select(line.alias("value")).write.text(folder)
    read = files.text_rows(files.texts(files.files(spark, folder)), "path")
    return read.select(F.col("cells")[1].cast("long").alias("o_orderkey"), F.col("cells")[2].alias("status"))


def text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return files.has_text_layer(d.select("doc_id", "text"), "doc_id")


def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as layouts against templates written as JSON, some of them known already."""
    folder = scratch(spark, "templates")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.when(F.col("p_partkey") % 2 == 0, "invoice").otherwise("receipt").alias("type"), text.fingerprint(F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))).alias("fingerprint"), F.col("p_type").alias("header_text"), F.array("p_type").alias("columns"), "p_size", "p_type")
    each = F.struct("source", "type", "fingerprint", "header_text", "columns")
    p.where("p_size <= 30").groupBy(F.col("source").alias("of")).agg(F.to_json(F.collect_set(each)).alias("value")).write.partitionBy("of").text(folder)  # an array in each file
    known = files.templates(spark, folder)
    known = sinks.merged_templates(known, p.where("p_size > 40").select(*known.columns))
    layouts = p.select("p_type", "p_size", "fingerprint").distinct()
    return files.match_templates(layouts, known, ("invoice", "receipt")).select("p_type", "p_size", F.col("template").isNotNull().alias("known"))


def _invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    items = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")))).alias("items"))
    head = F.create_map(F.lit("invoice_number"), F.col("o_orderkey").cast("string"), F.lit("subtotal"), F.lit("5"), F.lit("currency"), F.col("o_orderstatus"))
    totals = F.create_map(F.lit("grand_total"), F.format_string("%.2f", "o_totalprice"), F.lit("subtotal"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("7"))
    return o.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), head.alias("header"), "items", totals.alias("totals"))


def invoice_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, items, totals = sinks.invoice_tables(_invoice_rows(spark, sf_dir))
    label = lambda df, part: df.select("doc_id", F.lit(part).alias("part"), F.col("pos").alias("at"), "field", "value")
    lines = items.select("doc_id", F.lit("items").alias("part"), F.col("item_no").alias("at"), F.col("part").cast("string").alias("field"), F.format_string("%.0f", "qty").alias("value"))
    return label(head, "head").union(lines).union(label(totals, "totals")).where("value <> ''")


def data_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.data_sheet(_invoice_rows(spark, sf_dir)).select("doc_id", "invoice_number", "currency", "item_no", "part", "qty")


def totals_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    own = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.round("o_totalprice", 2)).alias("subtotal"), F.lit(None).cast("double").alias("tax_amount"), F.lit(0.2).alias("tax_rate"), F.when(F.col("o_orderkey") % 3 == 0, 99.0).alias("grand_total"), F.lit(-1.0).alias("discount"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("line_total"))
    return sinks.totals_block(own, items)


def stacked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return sinks.stacked(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("region"), (F.col("o_orderkey") % 10 + 1).alias("height")))


def sheet_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    named = s.select("s_nationkey", F.col("s_suppkey").alias("position"), F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit("Part/"), (F.col("s_suppkey") % 3).cast("string"), F.lit(" of a very long name of a sheet"))).alias("name"))
    return sinks.sheet_titles(named, ["s_nationkey"]).select("s_nationkey", "position", "title")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/in/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name", F.lit(".scan.pdf"))
    value = _turn("c_custkey", F.col("c_acctbal"), F.lit(float("nan")), F.lit(float("inf")))
    return c.select("c_custkey", sinks.output_name(path).alias("output"), sinks.cached_value(value).alias("value"))


def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of cleaned rows that are unsure, and rows that are flagged without any."""
    li = _lines(spark, sf_dir)
    made = sinks.cleaned_table(li.select("l_orderkey", "n", F.array(F.lit(""), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("cells"), F.array(F.lit(1.0), (F.col("l_partkey") % 100).cast("double"), F.lit(90.0)).alias("confidence"), (F.col("l_linenumber") == 1).alias("flagged")), F.lit(4))
    return made.select("l_orderkey", "n", F.size("cells").alias("width"), F.array_join("review", ",").alias("review"))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    made = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: F.struct(i.alias("row"), F.concat(F.lit("cell "), i.cast("string")).alias("cell")))
    return sinks.review_queue(o.select(F.col("o_orderkey").cast("string").alias("source"), made.alias("review_items")))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return sinks.review_summary(o.select(F.array_repeat(F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("pages"), (F.col("o_orderkey") % 10).alias("items"), F.array_repeat(F.lit(1), (F.col("o_orderkey") % 2).cast("int")).alias("repaired"), (F.col("o_orderkey") >= 0).alias("evidence_checked")))


def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cells = F.split(F.coalesce("text", F.lit("")), " ")
    made = d.select("doc_id", rows.pad(cells, (F.size(cells) + F.col("doc_id") % 5).cast("int")).alias("p"))
    return made.select("doc_id", F.size("p").alias("width"), F.size(F.filter("p", lambda x: x == "")).alias("blank"))


QUERIES = {f.__name__: f for f in (
    ocr_texts, display_texts, number_texts, clock_texts, misread_headings, evidence_merge, evidence_overlay, best_candidates, details_boxes, labels_over_values, value_below, suppressed_boxes,
    page_mastheads, item_headers, amount_headings, planned_columns, unsure_cells, plan_lookup, job_states, stage_upserts, best_items, model_answers, sniffed_kinds, csv_files, csv_master, text_files,
    text_layers, template_matches, invoice_workbook, data_sheet, totals_block, stacked_regions, sheet_titles, output_names, review_sheet, review_items, review_counts, padded_rows,
)}

_L = f"l AS (SELECT *, CAST({_N} AS INTEGER) AS n FROM lineitem)"

ORACLES = {
    "ocr_texts": """
        SELECT p_partkey, p_name || ' ' || p_brand AS tidy, p_partkey % 4 < 2 AS numeric, CASE WHEN p_partkey % 3 = 0 AND 6 > len(regexp_extract_all(p_brand, '[A-Za-z]')) THEN 'rtl' ELSE 'ltr' END AS direction,
               p_partkey % 3 = 0 AS named FROM part""",
    "display_texts": """
        SELECT c_custkey, (['"$"#,##0.00', '"€"#,##0.00', '#,##0.00" SAR"', '#,##0.00'])[c_custkey % 4 + 1] AS format, c_name || '.pdf' AS file,
               CASE WHEN c_custkey % 5 > 0 THEN '+20' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone, substr(sha1(lower(c_name || ' ' || c_mktsegment)), 1, 16) AS fingerprint,
               CASE WHEN c_custkey % 2 = 1 THEN 'end of ' || c_name ELSE c_name || ' of end' END AS joined FROM customer""",
    "number_texts": f"""
        WITH {_L}, p AS (SELECT *, round(l_extendedprice, 2) AS price FROM l)
        SELECT l_orderkey, n, printf('%.2f', price) AS plain, price AS found, price AS labelled, round(CAST(l_discount * 100 AS INTEGER) / 100.0, 6) AS share,
               CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS one, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber AS DOUBLE) END AS bare FROM p""",
    "clock_texts": """
        SELECT o_orderkey, o_orderkey % 3 <> 1 AS is_date, strftime(o_orderdate, '%Y-%m') AS month, CAST(greatest(0, (o_orderkey % 100 - 20) * 1000) AS BIGINT) AS ms FROM orders""",
    "misread_headings": "SELECT p_partkey, (['qty', 'supplier', 'description', 'zzqx wwvk'])[p_partkey % 4 + 1] AS canonical FROM part",
    "evidence_merge": """
        WITH f AS (SELECT o_custkey AS doc_id, o_orderstatus AS key, o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS value, o_orderkey % 3 AS prio, o_orderkey FROM orders WHERE o_orderkey % 4 > 0)
        SELECT DISTINCT doc_id, key, first_value(value) OVER (PARTITION BY doc_id, key ORDER BY prio, value) AS best, first_value(value) OVER (PARTITION BY doc_id, key ORDER BY o_orderkey) AS first,
               first_value(value) OVER (PARTITION BY doc_id, key ORDER BY o_orderkey DESC) AS last FROM f""",
    "evidence_overlay": "SELECT c_custkey, lower(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'placed' END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "best_candidates": f"""
        WITH {_L} SELECT l_orderkey, CAST(arg_max(l_partkey, n) FILTER (WHERE n % 2 = 1) AS VARCHAR) AS part, CAST(max(n) AS VARCHAR) AS line FROM l GROUP BY 1""",
    "details_boxes": """
        SELECT o_orderkey, 'Order no' AS label, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Status', o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey, 'Priority', o_orderpriority FROM orders WHERE o_orderkey % 2 = 1""",
    "labels_over_values": """
        SELECT o_orderkey, 'Order' AS label, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'Status', o_orderstatus FROM orders
        UNION ALL SELECT o_orderkey, 'Priority', o_orderpriority FROM orders WHERE o_orderkey % 3 > 0""",
    "value_below": f"""
        WITH {_L} SELECT a.l_orderkey, a.n * 3 AS label_idx, b.n * 3 AS word_idx, CAST(b.l_partkey AS VARCHAR) AS value FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1 WHERE a.n % 2 = 1""",
    "suppressed_boxes": f"""
        WITH {_L} SELECT l_orderkey, n * 3 + k AS word_idx, v AS text, v || '?' AS others FROM
        (SELECT l_orderkey, n, CAST(unnest(range(3)) AS INTEGER) AS k, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)]) AS v FROM l)""",
    "page_mastheads": "SELECT doc_id, text AS masthead FROM documents WHERE doc_id % 4 > 0 AND length(text) <= 60 AND NOT contains(text, chr(10))",
    "item_headers": "SELECT c_custkey, CAST(c_custkey % 7 + 1 AS INTEGER) AS header_row FROM customer",
    "amount_headings": """
        SELECT c_custkey, 'qty' AS role, 1 AS c FROM customer UNION ALL SELECT c_custkey, 'taxable', 2 FROM customer UNION ALL SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'vat' ELSE 'tax_rate' END, 3 FROM customer
        UNION ALL SELECT c_custkey, 'line_total', 4 FROM customer""",
    "planned_columns": """
        WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['Name', 'column_2', 'Balance', 'Segment'] ELSE ['Name', 'Balance', 'Segment'] END AS h FROM customer)
        SELECT c_custkey, CAST(unnest(range(len(h))) AS INTEGER) AS position, unnest(h) AS heading FROM h""",
    "unsure_cells": f"WITH {_L} SELECT l_orderkey, n, CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 60 < 35 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS cell FROM l",
    "plan_lookup": """
        SELECT 'p' || CAST(c_custkey % 30 AS VARCHAR) AS plan_slug, c_custkey, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_regionkey AS DOUBLE) END AS price FROM customer JOIN nation ON c_custkey % 30 = n_nationkey""",
    "job_states": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'failed' WHEN o_orderkey % 3 > 0 THEN 'needs_review' WHEN o_orderkey % 2 > 0 THEN 'auto_corrected' ELSE 'success' END AS label,
               (['cancelled', 'cancelled', 'completed', 'failed'])[o_orderkey % 4 + 1] AS after_cancel, CASE WHEN o_orderkey % 6 IN (0, 5) THEN 'no_page_read' WHEN o_orderkey % 4 = 1 THEN 'source_missing' WHEN o_orderkey % 5 IN (1, 2, 4) OR o_orderkey % 6 = 3 THEN 'reader_unavailable' ELSE 'reader_failed' END AS code,
               CASE WHEN o_orderkey % 5 = 0 THEN 'a,b,1' ELSE 'a,b,1,2' END AS warnings, CASE WHEN o_orderkey % 2 = 0 THEN 'small' WHEN o_orderkey % 3 = 0 THEN 'large' END AS model FROM orders""",
    "stage_upserts": "SELECT user_id AS job_id, event_type AS stage, arg_max(event_id % 1000, event_id) AS ms FROM events GROUP BY 1, 2",
    "best_items": f"""
        WITH {_L} SELECT l_orderkey, 'goods ' || CAST(l_partkey % 3 AS VARCHAR) AS description, l_quantity AS conf, n AS item_no FROM l
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_quantity DESC, n DESC) = 1""",
    "model_answers": "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS qty FROM part",
    "sniffed_kinds": "SELECT doc_id, (['pdf', 'png', 'jpeg', 'zip', 'unknown', 'csv'])[doc_id % 6 + 1] AS kind FROM documents",
    "csv_files": "SELECT s_suppkey, 'Big \"' || s_name || '\", Inc' AS supplier, s_nationkey AS nation FROM supplier",
    "csv_master": "SELECT 'supplier' AS field, s_name || ' Ltd' AS value FROM supplier UNION ALL SELECT 'line', s_name || '  Ltd' FROM supplier",
    "text_files": "SELECT o_orderkey, o_orderstatus AS status FROM orders",
    "text_layers": r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\x{85}\p{Z}]', '', 'g')) >= 80 AS present FROM documents",
    "template_matches": "SELECT DISTINCT p_type, p_size, p_size <= 30 OR p_size > 40 AS known FROM part",
    "invoice_workbook": f"""
        WITH {_L}, o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
        SELECT o_orderkey AS doc_id, 'head' AS part, 2 AS at, 'invoice_number' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM o UNION ALL SELECT o_orderkey, 'head', 6, 'currency', o_orderstatus FROM o
        UNION ALL SELECT l_orderkey, 'items', n - 1, CAST(l_partkey AS VARCHAR), printf('%.0f', l_quantity) FROM l JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT o_orderkey, 'totals', 0, 'subtotal', CASE WHEN o_orderkey % 2 = 0 THEN '5' ELSE '7' END FROM o UNION ALL SELECT o_orderkey, 'totals', 3, 'grand_total', printf('%.2f', o_totalprice) FROM o""",
    "data_sheet": f"""
        WITH {_L} SELECT l_orderkey AS doc_id, CAST(l_orderkey AS VARCHAR) AS invoice_number, o_orderstatus AS currency, n - 1 AS item_no, l_partkey AS part, l_quantity AS qty FROM l JOIN orders ON o_orderkey = l_orderkey""",
    "totals_block": """
        WITH s AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1),
             o AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS sub, CASE WHEN o_orderkey % 3 = 0 THEN 99.0 END AS grand FROM orders),
             b AS (SELECT *, coalesce(sub, CASE WHEN grand IS NULL THEN s END) AS own FROM o LEFT JOIN s ON doc_id = l_orderkey)
        SELECT doc_id, sub AS printed_subtotal, s AS computed_subtotal, CAST(NULL AS DOUBLE) AS printed_tax, round(own * 0.2, 2) AS computed_tax, CAST(grand AS DOUBLE) AS printed_grand,
               round(own + coalesce(round(own * 0.2, 2), 0) - 1, 2) AS computed_grand FROM b""",
    "stacked_regions": """
        SELECT o_custkey AS doc_id, o_orderkey AS region, o_orderkey % 10 + 1 AS height,
               CAST(coalesce(sum(o_orderkey % 10 + 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM orders""",
    "sheet_titles": """
        WITH t AS (SELECT s_nationkey, s_suppkey AS position, CASE WHEN s_suppkey % 5 = 0 THEN 'Sheet' ELSE trim(substr('Part ' || CAST(s_suppkey % 3 AS VARCHAR) || ' of a very long name of a sheet', 1, 31)) END AS t FROM supplier),
             k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, lower(t) ORDER BY position) AS k FROM t)
        SELECT s_nationkey, position, CASE WHEN k = 1 THEN t ELSE substr(t, 1, 31 - length('_' || CAST(k AS VARCHAR))) || '_' || CAST(k AS VARCHAR) END AS title FROM k""",
    "output_names": """
        SELECT c_custkey, c_name || '.scan_' || substr(sha1('/in/' || CAST(c_nationkey AS VARCHAR) || '/' || c_name || '.scan.pdf'), 1, 8) AS output, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value FROM customer""",
    "review_sheet": f"WITH {_L} SELECT l_orderkey, n, 4 AS width, CASE WHEN l_partkey % 100 < 75 OR l_linenumber = 1 THEN '1' ELSE '' END AS review FROM l",
    "review_items": "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS source, CAST(unnest(range(1, o_orderkey % 3 + 2)) AS INTEGER) AS row FROM orders) SELECT source, row, 'cell ' || CAST(row AS VARCHAR) AS cell FROM o",
    "review_counts": """
        SELECT CAST(sum(o_orderkey % 4) AS BIGINT) AS pages, CAST(sum(o_orderkey % 10) AS BIGINT) AS items, CAST(sum(o_orderkey % 2) AS BIGINT) AS corrections, true AS evidence_on_all FROM orders""",
    "padded_rows": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS c FROM documents)
        SELECT doc_id, CAST(len(c) + doc_id % 5 AS INTEGER) AS width, CAST(doc_id % 5 + len(list_filter(c, lambda x: x = '')) AS INTEGER) AS blank FROM d""",
}
