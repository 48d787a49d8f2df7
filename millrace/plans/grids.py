"""Queries on ruled grids, tables of words and whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import DIRTY, PAGE_TOKENS
from ..operators import accounts, assembly, choices, free_items, layout, pages, ruled, word_tables
from ..session import workers_import
from ..sources import files, formulas
from .invoices import _N, _lines
from .tables import table


def _word(i, x: float, y, text, wide: float = 40.0, high: float = 12.0, conf: float = 90.0) -> Column:  # noqa: ANN001
    """A word's box by its left end and its middle down the page."""
    at = F.lit(float(y)) if isinstance(y, (int, float)) else y.cast("double")
    return F.struct(
        F.lit(i).cast("long").alias("word_idx"), (F.lit(text) if isinstance(text, str) else text).cast("string").alias("text"), F.lit(conf).alias("conf"),
        F.lit(float(x)).alias("x0"), F.lit(x + wide).alias("x1"), (at - high / 2).alias("y0"), (at + high / 2).alias("y1"),
    )


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with ``n`` (place in the order) and ``k`` (how many the order has)."""
    return _lines(spark, sf_dir).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))


def _words_of(li: DataFrame, item: list[Column], fixed: list[Column]) -> DataFrame:
    """The words of orders' pages: each line's ``item``, and with an order's first line its ``fixed`` ones."""
    every = F.concat(F.array(*item), F.when(F.col("n") == 1, F.array(*fixed)).otherwise(F.array().cast(item_type())))
    return li.select("l_orderkey", F.inline(every))


def ruled_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' pages with a frame and a heading. Every row of a third of them is ruled, each rule read twice; a third has a
    narrow column of item numbers, and a second line of text under each item; the rest has text alone, and a total far below, which
    a long order moves down, and the end of its page with it."""
    li = _orders_lines(spark, sf_dir)
    way = F.col("l_orderkey") % 3
    page = li.where("n = 1").select("l_orderkey", "k", way.alias("way"))
    xs = F.when(F.col("way") == 1, F.array(*[F.lit(float(x)) for x in (0, 24, 200, 260, 320, 380, 440, 500)])).otherwise(F.array(*[F.lit(float(x)) for x in (0, 100, 300, 500)]))
    bottom = F.when(F.col("way") == 0, 131 + 30 * F.col("k")).otherwise(F.greatest(F.lit(900), 400 + 40 * F.col("k")))
    frame = F.array(F.lit(100), F.lit(101), F.lit(130), F.lit(131), bottom - 1, bottom)
    across = page.select("l_orderkey", F.lit("x").alias("axis"), F.explode(xs).alias("at"))
    down = page.select("l_orderkey", F.lit("y").alias("axis"), F.explode(F.transform(frame, lambda y: y.cast("double"))).alias("at"))
    each = li.where(way == 0).select("l_orderkey", F.lit("y").alias("axis"), F.explode(F.array(100 + 30 * (F.col("n") + 1), 101 + 30 * (F.col("n") + 1)).cast("array<double>")).alias("at"))
    y = F.when(way == 1, 160 + 40 * (F.col("n") - 1)).otherwise(145 + 30 * (F.col("n") - 1))
    item = F.array(_word(0, 2, y, F.col("n"), 18.0), _word(1, 120, y, F.col("l_partkey")), _word(2, 400, y, F.format_string("%.2f", "l_extendedprice")))
    second = F.when(way == 1, F.array(_word(3, 120, y + 16, F.lit("دفتر")))).otherwise(F.array().cast(item_type()))
    words = li.select("l_orderkey", "n", F.explode(F.concat(item, second)).alias("w")).select("l_orderkey", (F.col("n") * 4 + F.col("w.word_idx")).alias("word_idx"), *[f"w.{c}" for c in ("text", "conf", "x0", "x1", "y0", "y1")])
    below = F.greatest(F.lit(700), 300 + 30 * F.col("k"))
    total = page.where("way = 2").select("l_orderkey", F.explode(F.array(_word(1000, 120, below, "Total"), _word(1001, 400, below, "9.00"))).alias("w")).select("l_orderkey", "w.*")
    cells = ruled.ruled_cells(across.unionByName(down).unionByName(each), words.unionByName(total), ["l_orderkey"])
    return cells.groupBy("l_orderkey", "way", "r").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("cells"))


def item_type() -> str:
    return "array<struct<word_idx:bigint,text:string,conf:double,x0:double,x1:double,y0:double,y1:double>>"


def headed_word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' pages without rules: a line of other headings that stands alone, the items below their own headings, the third item's
    number misread, and a total far below, the farther the longer the order."""
    li = _orders_lines(spark, sf_dir)
    y = 200 + 20 * F.col("n")
    number = F.when(F.col("n") == 3, 8).otherwise(F.col("n"))
    item = [_word(100 * F.col("n") + 10, 10, y, number, 10.0), _word(100 * F.col("n") + 11, 80, y, F.concat(F.lit("Part"), F.col("l_partkey").cast("string"))), _word(100 * F.col("n") + 12, 124, y, "blue"), _word(100 * F.col("n") + 13, 250, y, F.col("l_quantity").cast("int")), _word(100 * F.col("n") + 14, 330, y, F.format_string("%.2f", "l_discount")), _word(100 * F.col("n") + 15, 420, y, F.format_string("%.2f", "l_extendedprice"))]
    others = [_word(1, 10, 60, "Customer"), _word(2, 150, 60, "Phone"), _word(3, 300, 60, "City")]
    heads = [_word(i + 4, x, 200, t) for i, (x, t) in enumerate(((10, "No"), (90, "Item"), (250, "Qty"), (330, "Rate"), (420, "Amount")))]
    below = F.greatest(F.lit(700), 500 + 20 * F.col("k"))
    foot = [_word(90_000, 10, below, "Total"), _word(90_001, 250, below, "12"), _word(90_002, 420, below, "99.00")]
    return word_tables.word_tables(_words_of(li, item, [*others, *heads, *foot]), ["l_orderkey"])


def chosen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's figures, names or flag as two recognisers read it, as sure as part and supplier numbers say."""
    li = table(spark, sf_dir, "lineitem")
    n = (F.col("l_partkey") % 8).cast("int")
    en = F.get(F.array(F.lit("3"), F.lit("Name"), F.lit("12"), F.lit(""), F.lit("x9"), F.lit(""), F.lit("7.5%"), F.col("l_returnflag")), n)
    ar = F.get(F.array(F.lit("يم"), F.lit("اسم"), F.lit("١٢"), F.lit("كتاب"), F.lit(""), F.lit("AB"), F.lit("7.5%"), F.lit("")), n)
    sure, other = (F.col("l_suppkey") % 10) / 10.0, (F.col("l_linenumber") % 10) / 10.0
    r = choices.choose_box(en, sure, ar, other)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.text", "r.conf", "r.script")


def chosen_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as read with the page and again: without their point, with a letter, with a mark, or short of a digit."""
    li = table(spark, sf_dir, "lineitem")
    price = F.format_string("%.2f", "l_extendedprice")
    way = (F.col("l_partkey") % 5).cast("int")
    first = F.get(F.array(F.replace(price, F.lit("."), F.lit("")), price, F.concat(F.lit("~"), price), price, F.lit("")), way)
    second = F.get(F.array(price, F.replace(price, F.lit("."), F.lit("")), price, F.substring(price, 2, 99), F.replace(price, F.lit("."), F.lit(""))), way)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", choices.choose_cell(first, second, F.lit(2), DIRTY).alias("text"))


def best_page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each order's page: words without sums, sums without words, both but nothing else."""
    o = table(spark, sf_dir, "orders")
    total = F.format_string("%.2f", "o_totalprice")
    texts = F.array(F.concat(F.lit("Invoice for customer, total and tax of item "), F.col("o_orderkey").cast("string")), F.concat_ws(" ", F.col("o_orderstatus"), total, F.lit("$ 1.00")), F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"), F.lit(" Total $"), total))
    readings = o.select("o_orderkey", F.posexplode(texts).alias("reading", "text"))
    scored = readings.withColumn("score", choices.page_score(F.col("text")))
    return scored.groupBy("o_orderkey").agg(choices.best_of(F.struct("reading", "text", "score"), F.col("score")).alias("b")).select("o_orderkey", "b.reading", "b.score")


def best_cell_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of a cell of each line, in a column that its line number names, scored and the best one taken."""
    li = table(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_linenumber") % 3 == 0, "qty").when(F.col("l_linenumber") % 3 == 1, "description").otherwise("other")
    heading = F.col("l_linenumber") % 3 == 1
    sure = (F.lit(40.0), (F.col("l_partkey") % 100).cast("double"), F.lit(99.0), F.lit(100.0))
    texts = F.array(*[F.struct(F.lit(t).alias("t"), c.alias("c")) for t, c in zip(("12", "item", "=[i]~", ""), sure, strict=True)])
    readings = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", field.alias("field"), heading.alias("heading"), F.posexplode(texts).alias("reading", "r")).select("*", "r.t", "r.c")
    canonical = F.when(F.col("t") == "item", "description").otherwise(F.col("t"))
    scored = readings.withColumn("score", choices.reading_score(F.col("t"), F.col("c"), F.col("field"), F.col("heading"), canonical))
    best = choices.best_of(F.struct("reading", F.col("t").alias("text"), "score"), F.col("score")).alias("b")
    return scored.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(best).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.reading", "b.text", F.round("b.score", 6).alias("score"))


def _page_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders' pages: a letterhead, a list of three pairs, a title, the items below headings, a note; Arabic where the order is
    divisible by five. Quantity and price of the items all but touch, and a printed rule parts them where the order is even;
    another rule crosses a word, and a third one is short. A speck of dust lies beside each item."""
    li = _orders_lines(spark, sf_dir)
    arabic = F.col("l_orderkey") % 5 == 0
    says = lambda en, ar: F.when(arabic, ar).otherwise(en)
    y = 330 + 16 * F.col("n")
    item = [_word(1000 + 10 * F.col("n") + 0, 20, y, F.col("n"), 12.0), _word(1000 + 10 * F.col("n") + 1, 120, y, says("blue", "ازرق"), 34.0), _word(1000 + 10 * F.col("n") + 2, 156, y, says("part", "قطعة"), 34.0), _word(1000 + 10 * F.col("n") + 3, 300, y, F.col("l_quantity").cast("int"), 58.0), _word(1000 + 10 * F.col("n") + 4, 360, y, F.format_string("%.2f", "l_extendedprice"), 60.0), _word(1000 + 10 * F.col("n") + 5, 460, y, ".", 3.0, 12.0, 5.0)]
    fixed = [_word(0, 20, 40, says("Letterhead", "ترويسة"), 80.0)]
    for i, (en, ar) in enumerate((("Order", "طلب"), ("State", "حالة"), ("Place", "مكان"))):
        fixed += [_word(10 + 2 * i, 20, 120 + 16 * i, says(en, ar), 50.0), _word(11 + 2 * i, 200, 120 + 16 * i, says("one", "واحد"), 40.0, 12.0, 80.0)]
    fixed += [_word(30, 20, 310, says("Items", "اصناف"), 60.0)]
    fixed += [_word(40 + i, x, 330, says(en, ar), w) for i, (x, w, en, ar) in enumerate(((20, 40.0, "No", "رقم"), (120, 60.0, "Goods", "بضاعة"), (300, 58.0, "Amount", "كمية"), (360, 60.0, "Price", "سعر")))]
    fixed += [_word(90_000, 20, 2400, says("Thanks", "شكرا"), 60.0)]
    words = _words_of(li, item, fixed)
    rule = lambda x, a, b: F.struct(F.lit(float(x)).alias("x"), F.lit(float(a)).alias("y0"), F.lit(float(b)).alias("y1"))
    rules = li.where("n = 1 AND l_orderkey % 2 = 0").select("l_orderkey", F.explode(F.array(rule(359, 300, 2300), rule(140, 300, 2300), rule(320, 300, 310))).alias("w")).select("l_orderkey", "w.*")
    return words, rules


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, _ = pages.layout_document(*_page_words(spark, sf_dir), ["l_orderkey"])
    return regions.select("l_orderkey", "region", "kind", "title", "direction", "n_columns", "n_rows")


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.layout_document(*_page_words(spark, sf_dir), ["l_orderkey"])[1]


def _free_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' invoices as running text: a third has each figure on a line of its own, a third an item on a line (of every fifth item
    the price has lost its point; where the order is divisible by seven all have, and no total is printed), a third stands between bars."""
    li = _orders_lines(spark, sf_dir)
    way, n = F.col("l_orderkey") % 3, F.col("n")
    cents = F.col("l_partkey") % 9000 + 1000
    qty = F.col("l_quantity").cast("long")
    money = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("long"), c % 100)
    head = F.concat(F.lit("Item "), n.cast("string"))
    below = F.array(head, qty.cast("string"), F.concat(F.lit("$"), money(cents)), F.lit("ab"), F.concat(F.lit("$ "), money(qty * cents)))
    bare = F.array(F.concat(head, F.lit(" x"), qty.cast("string"), F.lit(" @ $"), cents.cast("string")))
    lost = F.array(F.concat(head, F.lit(" "), qty.cast("string"), F.lit(" $"), cents.cast("string"), F.lit(" $"), money(qty * cents)))
    one = F.array(F.concat(head, F.lit(" x"), qty.cast("string"), F.lit(" @ $"), money(cents), F.lit(" = $"), money(qty * cents)))
    bars = F.array(F.concat_ws(" | ", F.concat(F.lit("goods no "), F.col("l_partkey").cast("string")), qty.cast("string"), F.concat(F.lit("$"), money(cents)), F.concat(F.lit("$"), money(qty * cents))))
    text = F.when(way == 0, below).when(way == 2, bars).when(F.col("l_orderkey") % 7 == 0, bare).when(n % 5 == 0, lost).otherwise(one)
    body = li.select("l_orderkey", (n * 10).alias("_n"), F.posexplode(text).alias("_i", "text")).select("l_orderkey", (F.col("_n") + F.col("_i")).alias("line_no"), "text")
    sums = li.groupBy("l_orderkey").agg(F.sum(qty * cents).alias("s"))
    printed = (F.lit("scan-17.jpg item 9 9 $9.00 $81.00"), F.concat(F.lit("Sub Total $"), money(F.col("s"))), F.concat(F.lit("Total $"), money(F.col("s") + 500)))
    ends = F.array(*[F.struct(F.lit(i).alias("line_no"), t.alias("text")) for i, t in zip((0, 900_000, 900_001), printed, strict=True)])
    return body.unionByName(sums.select("l_orderkey", F.inline(ends)))


def free_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return free_items.free_items(_free_pages(spark, sf_dir), ["l_orderkey"])[0].drop("item_no")


def free_text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = free_items.free_totals(free_items.clean_lines(_free_pages(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])
    return found.select("l_orderkey", "subtotal", "tax_amount", "grand_total", "currency")


def even_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of orders: a tall heading, the items, a taller footer."""
    li = _orders_lines(spark, sf_dir)
    ends = li.select("l_orderkey", "k").distinct()
    rows = li.select("l_orderkey", F.col("n").alias("line"), F.lit(20.0).alias("height")).unionByName(ends.select("l_orderkey", F.lit(0).alias("line"), F.lit(60.0).alias("height")))
    rows = rows.unionByName(ends.select("l_orderkey", (F.col("k") + 1).cast("int").alias("line"), F.lit(90.0).alias("height")))
    return layout.uniform_rows(rows, ["l_orderkey"])


def modal_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of orders with four cells in a row, a little apart from row to row; every fourth row has lost its last one."""
    li = _orders_lines(spark, sf_dir)
    cells = li.select("l_orderkey", F.col("n").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where("r % 4 > 0 OR i < 3")
    left, top = 10 + 100 * F.col("i") + F.col("r") % 3, 50 * F.col("r") + F.col("i") % 2
    cells = cells.select("l_orderkey", "r", *[c.cast("double").alias(n) for n, c in (("x0", left), ("x1", left + 80), ("y0", top), ("y1", top + 30))])
    return ruled.modal_grid(cells, ["l_orderkey"], F.lit(500.0))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' invoices over two pages: a title, text, a table of details, the items in two tables (the second one without headings,
    where there are four or more; a group heading stands above the second item), and a box of totals. Where the order is
    divisible by three the totals are a line of the items' table; where by seven the text states another invoice number."""
    li = _orders_lines(spark, sf_dir)
    price = F.col("l_partkey") % 900 + 101
    qty = F.col("l_quantity").cast("long")
    first = F.col("n") <= F.floor((F.col("k") + 3) / 2)
    row = F.format_string("<tr><td>part number %d</td><td>%d</td><td>$%d.00</td><td>$%d.00</td></tr>", "l_partkey", qty, price, price * qty)
    row = F.concat(F.when(F.col("n") == 2, "<tr><td colspan='4'>Second group</td></tr>").otherwise(""), row)
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("n", row.alias("t"))))), lambda x: x["t"]), "")
    of = F.col("l_orderkey")
    order = li.groupBy("l_orderkey").agg(joined(first).alias("a"), joined(~first).alias("b"), F.sum(price * qty).alias("s"), F.sum(qty).alias("q"))
    heads = "<tr><th>Description</th><th>Qty</th><th>Unit price</th><th>Amount</th></tr>"
    inside = lambda last: F.when((of % 3 == 0) & last, F.format_string("<tr><td>Total</td><td>%d</td><td></td><td>$%d.00</td></tr>", "q", "s")).otherwise("")
    upper = F.concat(F.lit("<table>" + heads), "a", inside(F.col("b") == ""), F.lit("</table>"))
    lower = F.concat(F.lit("<table>"), "b", inside(F.lit(True)), F.lit("</table>"))
    text = F.concat(F.lit("Invoice Date: 03/02/2020\nBank: First National\nSold to\nMs Someone\nHigh Street 1\n"), F.when(of % 7 == 0, "Invoice No: WRONG-1\n").otherwise(""))
    details = F.concat(F.lit("<table><tr><td>Invoice No</td><td>INV-"), of.cast("string"), F.lit("</td></tr><tr><td>Payment Terms</td><td>thirty days</td></tr></table>"))
    box = F.format_string("<table><tr><td>Subtotal</td><td>$%d.00</td></tr><tr><td>VAT</td><td>$5.00</td></tr><tr><td>Grand Total</td><td>$%d.00</td></tr></table>", "s", F.col("s") + 5)
    made = ((0, "title", F.lit("INVOICE")), (1, "text", text), (2, "table", details), (3, "table", upper), (4, "table", F.when(F.col("b") != "", lower)), (5, "table", F.when(of % 3 > 0, box)))
    blocks = F.array(*[F.struct(F.lit(i).alias("block_idx"), F.lit(k).alias("kind"), c.alias("content")) for i, k, c in made])
    return order.select(of.alias("doc_id"), F.inline(F.filter(blocks, lambda b: b["content"].isNotNull())))


def payload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.payload(_documents(spark, sf_dir)).items.select("doc_id", "item_no", "section", "grid", "description", "qty", "unit_price", "line_total")


def payload_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.payload(_documents(spark, sf_dir)).header


def payload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.payload(_documents(spark, sf_dir)).totals


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: a group heading above the second item, totals as the order number says: none, a grand total, all with a
    tax rate, or with a discount; every fifth price is missing, and the totals of every seventh part are doubtful."""
    li = _orders_lines(spark, sf_dir)
    price = (F.col("l_partkey") % 900 + 101).cast("double")
    items = li.select("l_orderkey", F.col("n").alias("item_no"), F.when(F.col("n") == 2, "Second group").alias("section"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("what"), F.col("l_quantity").alias("amount"), F.when(F.col("l_partkey") % 5 > 0, price).alias("price"), (price * F.col("l_quantity") + 1).alias("sum"), F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("sum"))).alias("review"))
    way, some = F.col("l_orderkey") % 4, lambda test, v: F.when(test, F.lit(v))
    totals = li.select("l_orderkey").distinct().select("l_orderkey", some(way >= 2, 50.0).alias("subtotal"), some(way == 3, -4.0).alias("discount"), some(way == 2, 6.0).alias("tax_amount"), some(way >= 1, 99.0).alias("grand_total"), F.lit(None).cast("double").alias("amount_paid"), some(way == 2, 0.25).alias("tax_rate"))
    return formulas.document_sheet(items, totals, ["l_orderkey"], (("what", "description"), ("amount", "qty"), ("price", "unit_price"), ("sum", "line_total")))


def sheet_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir)


def sheet_review_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.cells_to_review(_sheet(spark, sf_dir), ["l_orderkey"])


def mapped_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' tables with detected grids of three columns. The grid of every third order lies beside its words, and that of every
    third one has as many rows without words as with them and two more."""
    li = _orders_lines(spark, sf_dir)
    way, y = F.col("l_orderkey") % 3, 30 * F.col("n")
    head = [_word(i, x, 6, t) for i, (x, t) in enumerate(((10, "Part"), (150, "Supplier"), (300, "Amount")))]
    item = [_word(3 * F.col("n") + 0, 10, y + 6, F.col("l_partkey")), _word(3 * F.col("n") + 1, 150, y + 6, F.col("l_suppkey")), _word(3 * F.col("n") + 2, 300, y + 6, F.format_string("%.2f", "l_extendedprice"))]
    words = _words_of(li, item, head)
    page = li.where("n = 1").select("l_orderkey", "k")
    many = F.when(way == 2, 2 * F.col("k") + 3).otherwise(F.col("k"))
    cells = page.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), many)).alias("r")).select("l_orderkey", "r", F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("c"))
    left = 145.0 * F.col("c") + F.when(way == 1, 2000.0).otherwise(0.0)
    cells = cells.select("l_orderkey", F.col("r").cast("int").alias("r"), "c", left.alias("x0"), (left + 140).alias("x1"), (30.0 * F.col("r")).alias("y0"), (30.0 * F.col("r") + 25).alias("y1"))
    return ruled.mapped_tables(words, cells, ["l_orderkey"])


def _zipped(rows: DataFrame, suffix: str, parts) -> DataFrame:  # noqa: ANN001
    """rows (path, lines: array of arrays of texts) as files: path, suffix, content, zipped in the tasks that have them."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            made = []
            for lines in batch["lines"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, body in parts([list(x) for x in lines]).items():
                        z.writestr(name, body)
                made.append(out.getvalue())
            yield pd.DataFrame({"path": batch["path"], "suffix": suffix, "content": made})

    workers_import(rows.sparkSession)
    return rows.mapInPandas(run, "path string, suffix string, content binary")


def _workbook(lines: list[list[str]]) -> dict[str, str]:
    """The parts of a workbook of two sheets: odd lines with shared texts, even ones with texts of their own."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = sorted({c for i, line in enumerate(lines) if i % 2 for c in line})
    cell = lambda i, j, c: f'<c r="{"ABC"[j]}{i + 1}" t="s"><v>{shared.index(c)}</v></c>' if i % 2 else f'<c r="{"ABC"[j]}{i + 1}" t="inlineStr"><is><t>{c}</t></is></c>'
    rows = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, c) for j, c in enumerate(line))}</row>' for i, line in enumerate(lines))
    sheet = lambda body: f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in ((1, "Data"), (2, "Notes")))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
    return {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"<si><t>{c}</t></si>" for c in shared)}</sst>',
        "xl/worksheets/sheet1.xml": sheet(rows), "xl/worksheets/sheet2.xml": sheet('<row r="3"><c r="B3"><v>4.5</v></c></row>'),
    }


def _letter(lines: list[list[str]]) -> dict[str, str]:
    """A document of a paragraph and a table."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    said = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join(f"<w:tr>{''.join(f'<w:tc>{said(c)}</w:tc>' for c in line)}</w:tr>" for line in lines)
    return {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{said("Dear customers")}<w:p/><w:tbl>{rows}</w:tbl></w:body></w:document>'}


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by hundreds of their numbers, a file each."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("f"), "c_custkey", F.array(F.col("c_custkey").cast("string"), "c_name", F.format_string("%.2f", "c_acctbal")).alias("line"))
    return c.groupBy(F.concat(F.lit("file-"), F.col("f").cast("string")).alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]).alias("lines"))


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.sheets(_zipped(_customer_files(spark, sf_dir), "xlsx", _workbook))
    return found.select("source", "sheet", "sheet_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


def office_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.office(_zipped(_customer_files(spark, sf_dir), "docx", _letter))
    return found.select("source", "kind", "row_idx", F.array_join("cells", "|").alias("cells"))


def direction_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' documents: a page for each line, Arabic where the part number is divisible by two."""
    li = table(spark, sf_dir, "lineitem")
    page = F.when(F.col("l_partkey") % 2 == 0, "فاتورة رقم").otherwise("Invoice No")
    return layout.page_direction(li.select("l_suppkey", (text.direction(page) == "rtl").alias("rtl")), ["l_suppkey"])


def plan_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of parts as plans, active where the last part of the brand is even, in the order in which they are shown; the seed is
    for a table without plans."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slug")).agg(F.max("p_partkey").alias("_k"))
    plans = p.select("slug", (F.col("_k") % 2 == 0).alias("active"), (F.col("_k") % 5).cast("int").alias("sort_order"), F.col("_k").cast("double").alias("price"))
    seed = plans.limit(0).unionByName(plans.sparkSession.createDataFrame([("free", True, 0, 0.0)], plans.schema))
    shown = accounts.active_plans(accounts.seed_plans(plans, seed)).select("slug", "sort_order", "price")
    return shown.unionByName(accounts.seed_plans(plans.limit(0), seed).select("slug", "sort_order", "price"))


def stacked_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's blocks on one sheet, all as wide as the widest: a title, its items (as many columns as its number says), a note."""
    li = _orders_lines(spark, sf_dir)
    cells = F.slice(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.lit("x"), F.lit("y")), F.lit(1), (F.col("l_orderkey") % 4 + 1).cast("int"))
    items = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    one = lambda i, t: items.select("l_orderkey", F.lit(i).alias("block_idx"), F.array(F.array(F.lit(t))).alias("rows"))
    blocks = one(0, "Title").unionByName(items.select("l_orderkey", F.lit(1).alias("block_idx"), "rows")).unionByName(one(2, "Note"))
    found = assembly.sheet_rows(blocks.withColumnRenamed("l_orderkey", "doc_id"))
    return found.select("doc_id", "row", F.size("cells").alias("width"), F.array_join("cells", "|").alias("cells"))


QUERIES = {"ruled_grid_rows": ruled_grid_rows, "headed_word_tables": headed_word_tables, "chosen_readings": chosen_readings, "chosen_cells": chosen_cells, "best_page_readings": best_page_readings, "best_cell_readings": best_cell_readings, "layout_regions": layout_regions, "layout_cells": layout_cells, "free_text_items": free_text_items, "free_text_totals": free_text_totals, "even_grid_rows": even_grid_rows, "modal_grids": modal_grids, "payload_items": payload_items, "payload_header": payload_header, "payload_totals": payload_totals, "sheet_formulas": sheet_formulas, "sheet_review_cells": sheet_review_cells, "mapped_grids": mapped_grids, "workbook_rows": workbook_rows, "office_rows": office_rows, "direction_majority": direction_majority, "plan_lifecycle": plan_lifecycle, "stacked_sheets": stacked_sheets}

_K = f"k AS (SELECT *, CAST({_N} AS INTEGER) AS n, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem)"

_SHEET = f"""{_K}, i AS (SELECT l_orderkey, n, k, n + 1 + CASE WHEN n >= 2 THEN 1 ELSE 0 END AS r, l_partkey, l_quantity AS q, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 900 + 101 AS DOUBLE) END AS p,
        (l_partkey % 900 + 101) * l_quantity + 1 AS s, l_partkey % 7 = 0 AS odd FROM k)"""

ORACLES = {
    # where every row is ruled, rules are many from four items on; else rows end half-way between lines of text
    "ruled_grid_rows": f"""
        WITH {_K}, p AS (SELECT l_orderkey, max(k) AS k, l_orderkey % 3 AS way FROM k GROUP BY ALL),
        a AS (SELECT l_orderkey, 'rules' AS way, i AS r, 100 + 30 * i AS y0, 130 + 30 * i AS y1, 3 AS cells FROM p, (SELECT unnest(range(100)) AS i) WHERE way = 0 AND k >= 4 AND i <= k),
        -- two numbers make a chain, and its rows end half-way between them; the last ends half a gap below its number
        b AS (SELECT l_orderkey, 'numbers' AS way, i AS r, CASE WHEN i = 0 THEN 100 WHEN i = 1 THEN 130 ELSE 140 + 40 * (i - 1) END AS y0, CASE WHEN i = 0 THEN 130 ELSE 140 + 40 * i END AS y1, 7 AS cells
              FROM p, (SELECT unnest(range(100)) AS i) WHERE way = 1 AND k >= 2 AND i <= k),
        -- one number is no chain: its two lines of text are rows, the second one to the end of the table
        b1 AS (SELECT l_orderkey, 'text' AS way, i AS r, ([100, 130, 168])[i + 1] AS y0, ([130, 168, 184])[i + 1] AS y1, 7 AS cells FROM p, (SELECT unnest(range(3)) AS i) WHERE way = 1 AND k = 1),
        t AS (SELECT l_orderkey, k, way, CASE WHEN k = 1 THEN 157 ELSE 130 + 30 * k END AS e FROM p WHERE way = 2 OR way = 0 AND k < 4),
        -- edges lie half-way between lines 30 apart; the last one half-way to the end of the table, if 4 remain below it
        g AS (SELECT l_orderkey, e, unnest([100, 130] || [160 + 30 * (i - 1) FOR i IN range(1, k)] || CASE WHEN k = 1 THEN [151] ELSE [122 + 30 * k] END) AS y FROM t),
        h AS (SELECT l_orderkey, e, y FROM g WHERE y < e - 4 OR y = 130 UNION ALL SELECT l_orderkey, e, e FROM (SELECT l_orderkey, e, max(y) AS m FROM g WHERE y < e - 4 OR y = 130 GROUP BY ALL) WHERE e - m >= 8),
        c AS (SELECT l_orderkey, y AS y0, lead(y) OVER (PARTITION BY l_orderkey ORDER BY y) AS y1 FROM h),
        d AS (SELECT l_orderkey, 'text' AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0) - 1 AS r, y0, y1, 3 AS cells FROM c WHERE y1 - y0 >= 8)
        SELECT l_orderkey, way, CAST(r AS INTEGER) AS r, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1, CAST(cells AS BIGINT) AS cells
        FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM d)""",
    # a table has two items at least; five make a column of numbers that is repaired and named
    "headed_word_tables": f"""
        WITH {_K}, p AS (SELECT * FROM k WHERE k >= 2), c AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS c)
        SELECT l_orderkey, 0 AS r, c, CASE WHEN c = 0 AND k >= 5 THEN 'row_number' ELSE (['No', 'Item', 'Qty', 'Rate', 'Amount'])[c + 1] END AS text, CAST(90.0 AS DOUBLE) AS conf, false AS repaired FROM p, c WHERE n = 1
        UNION ALL
        SELECT l_orderkey, n, c, CASE c WHEN 0 THEN CAST(CASE WHEN n = 3 AND k < 5 THEN 8 ELSE n END AS VARCHAR) WHEN 1 THEN 'Part' || CAST(l_partkey AS VARCHAR) || ' blue' WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
               WHEN 3 THEN printf('%.2f', l_discount) ELSE printf('%.2f', l_extendedprice) END, CASE WHEN c = 0 AND n = 3 AND k >= 5 THEN 55.0 ELSE 90.0 END, c = 0 AND n = 3 AND k >= 5 FROM p, c""",
    # figures are English whatever the other one says; Latin of the Arabic recogniser needs a lead of 0.15, its digits one of 0.25
    "chosen_readings": """
        WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_partkey % 8 AS n, (l_suppkey % 10) / 10.0 AS e, (l_linenumber % 10) / 10.0 AS a FROM lineitem),
        r AS (SELECT *, CASE n WHEN 0 THEN 'en' WHEN 1 THEN CASE WHEN a >= e THEN 'ar' ELSE 'en' END WHEN 2 THEN CASE WHEN a >= e + 0.25 THEN 'ar' WHEN e + 0.15 >= a THEN 'en' ELSE 'la' END WHEN 3 THEN 'ar' WHEN 4 THEN 'en'
                        WHEN 5 THEN 'la' WHEN 6 THEN CASE WHEN e + 0.15 >= a THEN 'en' ELSE 'la' END ELSE 'en' END AS k FROM l)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k = 'en' THEN (['3', 'Name', '12', '', 'x9', '', '7.5%', l_returnflag])[n + 1] ELSE (['يم', 'اسم', '١٢', 'كتاب', '', 'AB', '7.5%', ''])[n + 1] END AS text,
               CAST(CASE WHEN k = 'en' THEN e ELSE a END AS DOUBLE) AS conf, CASE WHEN k = 'ar' THEN 'ar' ELSE 'latin' END AS script FROM r""",
    # the second reading needs as many digits, and the places, or less dirt, that the first one lacks
    "chosen_cells": "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_extendedprice) AS text FROM lineitem WHERE l_partkey % 5 < 4 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '' FROM lineitem WHERE l_partkey % 5 = 4",
    "best_page_readings": f"""
        WITH t AS (SELECT o_orderkey, unnest(range(3)) AS i, unnest(['Invoice for customer, total and tax of item ' || CAST(o_orderkey AS VARCHAR), o_orderstatus || ' ' || printf('%.2f', o_totalprice) || ' $ 1.00', 'INV-' || CAST(o_orderkey AS VARCHAR) || ' Total $' || printf('%.2f', o_totalprice)]) AS t FROM orders),
        s AS (SELECT o_orderkey, i, CASE i WHEN 0 THEN 250 ELSE 0 END + CASE WHEN i = 2 THEN 100 ELSE 0 END + 20 * len(regexp_extract_all(t, '{PAGE_TOKENS[1]}')) + len(regexp_extract_all(t, '[A-Za-z0-9]')) AS score FROM t)
        SELECT o_orderkey, CAST(arg_max(i, score * 10 - i) AS INTEGER) AS reading, CAST(max(score) AS INTEGER) AS score FROM s GROUP BY 1""",
    "best_cell_readings": """
        WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 AS f, l_partkey % 100 AS c FROM lineitem),
        s AS (SELECT *, unnest([0, 1, 2]) AS i, unnest(CASE f WHEN 0 THEN [140.0, c - 80.0, 19.0] WHEN 1 THEN [40.0, c + 104.0, 100.0] ELSE [40.0, c + 2.8, 59.7] END) AS score FROM l)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(arg_max(i, score * 1000 - i) AS INTEGER) AS reading, arg_max((['12', 'item', '=[i]~'])[i + 1], score * 1000 - i) AS text, CAST(round(max(score), 6) AS DOUBLE) AS score FROM s GROUP BY ALL""",
    # quantity and price are one column but where a rule parts them; one item line and its headings make a table of two
    "layout_regions": f"""
        WITH {_K}, p AS (SELECT DISTINCT l_orderkey, k, l_orderkey % 5 = 0 AS ar, l_orderkey % 2 = 0 AS cut FROM k)
        SELECT l_orderkey, i AS region, (['text', 'key_value', 'table', 'text'])[i + 1] AS kind, CASE WHEN i <> 2 THEN '' WHEN ar THEN 'اصناف' ELSE 'Items' END AS title, CASE WHEN ar THEN 'rtl' ELSE 'ltr' END AS direction,
               (CASE i WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN cut THEN 4 ELSE 3 END ELSE 1 END) AS n_columns, CAST(CASE i WHEN 1 THEN 3 WHEN 2 THEN k ELSE 1 END AS INTEGER) AS n_rows FROM p, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)""",
    "layout_cells": f"""
        WITH {_K}, p AS (SELECT *, l_orderkey % 5 = 0 AS ar, l_orderkey % 2 = 0 AS cut FROM k), d AS (SELECT DISTINCT l_orderkey, ar, cut FROM p),
        o AS (SELECT l_orderkey, 0 AS region, 0 AS r, 0 AS c, CASE WHEN ar THEN 'ترويسة' ELSE 'Letterhead' END AS text, 90.0 AS conf FROM d UNION ALL SELECT l_orderkey, 3, 0, 0, CASE WHEN ar THEN 'شكرا' ELSE 'Thanks' END, 90.0 FROM d
              UNION ALL SELECT l_orderkey, 1, i, CASE WHEN ar THEN 1 ELSE 0 END, CASE WHEN ar THEN (['طلب', 'حالة', 'مكان'])[i + 1] ELSE (['Order', 'State', 'Place'])[i + 1] END, 90.0 FROM d, (SELECT unnest(range(3)) AS i)
              UNION ALL SELECT l_orderkey, 1, i, CASE WHEN ar THEN 0 ELSE 1 END, CASE WHEN ar THEN 'واحد' ELSE 'one' END, 80.0 FROM d, (SELECT unnest(range(3)) AS i)),
        h AS (SELECT l_orderkey, ar, cut, -1 AS r, CASE WHEN ar THEN ['رقم', 'بضاعة', 'كمية', 'سعر'] ELSE ['No', 'Goods', 'Amount', 'Price'] END AS t FROM d
              UNION ALL SELECT l_orderkey, ar, cut, n - 1, [CAST(n AS VARCHAR), CASE WHEN ar THEN 'قطعة ازرق' ELSE 'blue part' END, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), printf('%.2f', l_extendedprice)] FROM p),
        w AS (SELECT l_orderkey, ar, r, CASE WHEN cut THEN t WHEN ar THEN [t[1], t[2], t[4] || ' ' || t[3]] ELSE [t[1], t[2], t[3] || ' ' || t[4]] END AS t FROM h)
        SELECT l_orderkey, region, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, text, CAST(conf AS DOUBLE) AS conf FROM o
        UNION ALL SELECT l_orderkey, 2, CAST(r AS INTEGER), CAST(CASE WHEN ar THEN len(t) - i ELSE i - 1 END AS INTEGER), t[i], 90.0 FROM w, (SELECT unnest(range(1, 5)) AS i) WHERE i <= len(t)""",
    # labels below each other 88, in running text 86, on a plain line 90, between bars 84; without a total 70, and 65 once the subtotal has mended the price
    "free_text_items": """
        WITH l AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_partkey % 9000 + 1000 AS c, CAST(NUM AS INTEGER) AS n, l_orderkey % 3 AS way, sum(CAST(l_quantity AS BIGINT) * (l_partkey % 9000 + 1000)) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)
        SELECT l_orderkey, CASE WHEN way = 2 THEN 'goods no ' || CAST(l_partkey AS VARCHAR) ELSE 'Item ' || CAST(n AS VARCHAR) END AS description, CAST(q AS DOUBLE) AS qty, c / 100.0 AS unit_price, q * c / 100.0 AS total,
               CAST(CASE WHEN way = 0 THEN 88 WHEN way = 2 THEN 84 WHEN l_orderkey % 7 = 0 THEN 65 WHEN n % 5 = 0 THEN 90 ELSE 86 END AS DOUBLE) AS conf,
               -- the items are 5.00 below the printed total, which is too far where that is more than a fifth of it
               way = 1 AND l_orderkey % 7 = 0 OR 500 > greatest(100, 0.2 * (s + 500)) AS review FROM l""".replace("NUM", _N),
    "free_text_totals": """
        SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT) * (l_partkey % 9000 + 1000)) / 100.0 AS subtotal, CAST(5.0 AS DOUBLE) AS tax_amount, (sum(CAST(l_quantity AS BIGINT) * (l_partkey % 9000 + 1000)) + 500) / 100.0 AS grand_total, 'USD' AS currency
        FROM lineitem GROUP BY 1""",
    # three rows all stay; of more the even run stays, and the first row
    "even_grid_rows": f"""
        WITH {_K}, p AS (SELECT DISTINCT l_orderkey, k FROM k)
        SELECT l_orderkey, CAST(i AS INTEGER) AS line, CAST(CASE WHEN i = 0 THEN 60 WHEN i > k THEN 90 ELSE 20 END AS DOUBLE) AS height FROM p, (SELECT unnest(range(100)) AS i) WHERE i <= k OR k = 1 AND i = 2""",
    "modal_grids": f"""
        WITH {_K}, m AS (SELECT l_orderkey, median(n % 3) AS m FROM k WHERE n % 4 > 0 GROUP BY 1), c AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS c),
        e AS (SELECT l_orderkey, c, round_even(CASE WHEN c = 0 THEN 8 + m ELSE 100 * c + m END, 0) AS x0, round_even(CASE WHEN c = 3 THEN 392 + m ELSE 100 * (c + 1) + m END, 0) AS x1 FROM m, c)
        SELECT l_orderkey, n AS r, c, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(50 * n AS DOUBLE) AS y0, CAST(50 * n + 30 AS DOUBLE) AS y1 FROM k JOIN e USING (l_orderkey)""",
    "payload_items": f"""
        WITH {_K} SELECT l_orderkey AS doc_id, n AS item_no, CASE WHEN n >= 2 THEN 'Second group' END AS section, CASE WHEN n <= (k + 3) // 2 THEN 3 ELSE 4 END AS grid, 'part number ' || CAST(l_partkey AS VARCHAR) AS description,
               l_quantity AS qty, CAST(l_partkey % 900 + 101 AS DOUBLE) AS unit_price, CAST((l_partkey % 900 + 101) * CAST(l_quantity AS BIGINT) AS DOUBLE) AS line_total FROM k""",
    # a table that pairs label and value outranks patterns in text, these labels beside values, these headings above text
    "payload_header": """
        WITH o AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem)
        SELECT doc_id, unnest(['invoice_number', 'payment_terms', 'invoice_date', 'bank', 'client_name', 'currency']) AS key,
               unnest(['INV-' || CAST(doc_id AS VARCHAR), 'thirty days', '2020-02-03', 'First National', 'Ms Someone / High Street 1', 'USD']) AS value, unnest(['table', 'table', 'pattern', 'label', 'party', 'cells']) AS source FROM o""",
    "payload_totals": """
        WITH s AS (SELECT l_orderkey AS doc_id, CAST(sum((l_partkey % 900 + 101) * CAST(l_quantity AS BIGINT)) AS DOUBLE) AS s FROM lineitem GROUP BY 1)
        SELECT doc_id, 'grand_total' AS key, s AS value, 'column' AS source FROM s WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, unnest(['subtotal', 'tax_amount', 'grand_total']), unnest([s, 5.0, s + 5]), 'totals' FROM s WHERE doc_id % 3 > 0""",
    "sheet_formulas": f"""
        WITH {_SHEET}, x AS (SELECT *, CAST(r AS VARCHAR) AS a FROM i),
        c AS (SELECT l_orderkey, 'item' AS kind, r AS "row", 1 AS "column", 'A' || a AS address, 'part ' || CAST(l_partkey AS VARCHAR) AS text, NULL AS formula, CAST(NULL AS DOUBLE) AS result, NULL AS note, false AS review FROM x
              UNION ALL SELECT l_orderkey, 'item', r, 2, 'B' || a, NULL, NULL, q, NULL, odd AND p IS NOT NULL FROM x
              UNION ALL SELECT l_orderkey, 'item', r, 3, 'C' || a, NULL, NULL, p, NULL, false FROM x
              UNION ALL SELECT l_orderkey, 'item', r, 4, 'D' || a, NULL, CASE WHEN p IS NOT NULL THEN '=B' || a || '*C' || a END, CASE WHEN p IS NOT NULL THEN q * p ELSE s END, CASE WHEN p IS NOT NULL THEN 'read: ' || format('{{:,.2f}}', s) END, odd AND p IS NULL FROM x
              UNION ALL SELECT l_orderkey, 'group', 3, 1, 'A3', 'Second group', NULL, NULL, NULL, false FROM x WHERE n = 2),
        o AS (SELECT l_orderkey, l_orderkey % 4 AS way, max(r) AS last_, sum(CASE WHEN p IS NOT NULL THEN q * p ELSE s END) AS total FROM i GROUP BY 1),
        -- what is written below the items, in order: key, place, formula, result, what was read
        t AS (SELECT l_orderkey, last_ + 1 AS r, CASE WHEN way = 0 THEN 'computed_total' ELSE 'subtotal' END AS k, '=SUM(D2:D' || CAST(last_ AS VARCHAR) || ')' AS f, total AS v, CASE WHEN way > 0 THEN 'read: 50.00' END AS note FROM o WHERE way <> 1
              UNION ALL SELECT l_orderkey, last_ + 2, 'tax_amount', '=D' || CAST(last_ + 1 AS VARCHAR) || '*0.25', total * 0.25, 'read: 6.00' FROM o WHERE way = 2
              UNION ALL SELECT l_orderkey, last_ + 2, 'discount', NULL, -4.0, NULL FROM o WHERE way = 3
              UNION ALL SELECT l_orderkey, last_ + 1, 'grand_total', NULL, 99.0, NULL FROM o WHERE way = 1
              UNION ALL SELECT l_orderkey, last_ + 3, 'grand_total', '=D' || CAST(last_ + 1 AS VARCHAR) || CASE way WHEN 2 THEN '+D' || CAST(last_ + 2 AS VARCHAR) ELSE '-ABS(D' || CAST(last_ + 2 AS VARCHAR) || ')' END, CASE way WHEN 2 THEN total * 1.25 ELSE total - 4 END, 'read: 99.00' FROM o WHERE way >= 2)
        SELECT l_orderkey, kind, CAST("row" AS INTEGER) AS "row", "column", address, text, formula, result, note, review FROM c
        UNION ALL SELECT l_orderkey, 'label', CAST(r AS INTEGER), 3, 'C' || CAST(r AS VARCHAR), k, NULL, NULL, NULL, false FROM t
        UNION ALL SELECT l_orderkey, 'total', CAST(r AS INTEGER), 4, 'D' || CAST(r AS VARCHAR), NULL, f, CAST(v AS DOUBLE), note, false FROM t""",
    # a doubtful line total that is a formula is mended at its quantity
    "sheet_review_cells": f"""
        WITH {_SHEET} SELECT l_orderkey, CAST(r AS INTEGER) AS "row", CASE WHEN p IS NULL THEN 4 ELSE 2 END AS "column", CASE WHEN p IS NULL THEN 'D' ELSE 'B' END || CAST(r AS VARCHAR) AS address,
               format('{{:,.2f}}', CASE WHEN p IS NULL THEN s ELSE q END) AS value FROM i WHERE odd""",
    # a grid beside its words has none inside; one with more than 0.45 of its rows empty does not cover the table
    "mapped_grids": f"""
        WITH {_K}, w AS (SELECT l_orderkey, n AS r, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), printf('%.2f', l_extendedprice)] AS t FROM k UNION ALL SELECT DISTINCT l_orderkey, 0, ['Part', 'Supplier', 'Amount'] FROM k)
        SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'grid' ELSE 'words' END AS way, CAST(r AS INTEGER) AS r, i AS c, t[i + 1] AS text FROM w, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)""",
    "workbook_rows": """
        WITH c AS (SELECT 'file-' || CAST(c_custkey // 100 AS VARCHAR) AS source, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS i, CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || printf('%.2f', c_acctbal) AS cells FROM customer)
        SELECT source, 'Data' AS sheet, 0 AS sheet_idx, i AS row_idx, cells FROM c UNION ALL SELECT DISTINCT source, 'Notes', 1, 2, '|4.5' FROM c""",
    "office_rows": """
        WITH c AS (SELECT 'file-' || CAST(c_custkey // 100 AS VARCHAR) AS source, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS i, CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || printf('%.2f', c_acctbal) AS cells FROM customer)
        SELECT source, 'table' AS kind, i AS row_idx, cells FROM c UNION ALL SELECT DISTINCT source, 'text', 0, 'Dear customers' FROM c""",
    "direction_majority": "SELECT l_suppkey, CASE WHEN avg(CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'rtl' ELSE 'ltr' END AS direction FROM lineitem GROUP BY 1",
    "plan_lifecycle": "SELECT p_brand AS slug, CAST(max(p_partkey) % 5 AS INTEGER) AS sort_order, CAST(max(p_partkey) AS DOUBLE) AS price FROM part GROUP BY 1 HAVING max(p_partkey) % 2 = 0 UNION ALL SELECT 'free', 0, 0.0",
    "stacked_sheets": f"""
        WITH {_K}, b AS (SELECT l_orderkey, max(k) AS k, greatest(2, l_orderkey % 4 + 1) AS w FROM k GROUP BY 1),
        r AS (SELECT l_orderkey, 0 AS "row", ['Title'] AS t FROM b UNION ALL SELECT l_orderkey, n + 1, list_slice([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), 'x', 'y'], 1, l_orderkey % 4 + 1) FROM k UNION ALL SELECT l_orderkey, k + 3, ['Note'] FROM b)
        SELECT l_orderkey AS doc_id, CAST("row" AS BIGINT) AS "row", CAST(w AS INTEGER) AS width, array_to_string(list_resize(t, w, ''), '|') AS cells FROM r JOIN b USING (l_orderkey)""",
}
