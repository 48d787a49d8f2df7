"""Ruled grids, tables of words, regions, choices, free text and payloads on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import assembly, bands, choices, folds, free_items, layout, pages, ruled, word_tables

WORD = "p int, word_idx long, text string, conf double, x0 double, x1 double, y0 double, y1 double"
RULE = "p int, axis string, at double"


def word(i, x, y, text, wide=40.0, conf=90.0, high=12.0, p=1):
    return (p, i, text, conf, float(x), x + wide, y - high / 2, y + high / 2)


def edges(df, p=1):
    return sorted({(r.y0, r.y1) for r in df.collect() if r.p == p})


def rules(spark, xs, ys, p=1):
    return spark.createDataFrame([(p, "x", float(x)) for x in xs] + [(p, "y", float(y)) for y in ys], RULE)


def test_points_meet_the_intervals_that_hold_them(spark):
    rng = random.Random(2)
    points = [(rng.randint(0, 3), i, rng.uniform(-50, 50)) for i in range(300)] + [(1, 900, None)]
    spans = [(rng.randint(0, 3), i, a := rng.uniform(-50, 50), a + rng.choice([-1, 0, 3, 40])) for i in range(80)]
    left, right = spark.createDataFrame(points, "k int, i int, at double"), spark.createDataFrame(spans, "k int, j int, a double, b double")
    want = {(i, j) for k, i, x in points for m, j, a, b in spans if k == m and x is not None and a <= x <= b}
    met = lambda how: bands.meet(left, right, ["k"], F.col("at"), F.col("a"), F.col("b"), 7.0, None, how)
    assert sorted((r.i, r.j) for r in met("inner").collect()) == sorted(want)
    assert sorted(r.i for r in met("left_semi").collect()) == sorted({i for i, _ in want})
    assert sorted(r.i for r in met("left_anti").collect()) == sorted({p[1] for p in points} - {i for i, _ in want})
    boxes = right.where("a <= b").select("k", F.col("j").alias("l"), F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = {(j, l) for k, j, a, b in spans for m, l, c, d in spans if k == m and a <= b and c <= d and a <= d and c <= b}
    assert sorted((r.j, r.l) for r in bands.overlapping(right.where("a <= b"), boxes, ["k"], ("a", "b"), ("c", "d"), 5.0).collect()) == sorted(pairs)


def test_rules_of_a_page_of_many_words(spark):
    words = spark.range(100_000).select(F.lit(1).alias("p"), (F.col("id") % 100 * 20.0).alias("x0"), (F.col("id") % 100 * 20.0 + 15).alias("x1"), (F.col("id") / 100 * 10.0).alias("y0"), (F.col("id") / 100 * 10.0 + 8).alias("y1"))
    lines = spark.createDataFrame([(1, i, x, 0.0, 10_000.0) for i, x in enumerate((17.5, 110.0, 1018.0, 1999.0, 2500.0))], "p int, rule_idx int, x double, y0 double, y1 double")
    block = spark.createDataFrame([(1, 0.0, 2000.0, 0.0, 10_000.0)], "p int, x0 double, x1 double, y0 double, y1 double")
    found = layout.clear_rules(lines, block, words, ["p"])
    assert sorted(r.rule_idx for r in found.collect()) == [0, 2, 3]
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_rules_that_are_read_twice_are_one(spark):
    ys = ruled.row_rules(rules(spark, [], [100, 101, 103, 130, 136, 160, 200]), ["p"]).orderBy("i").collect()
    # 100 and 101 make 100 (half to even), with 103 102; 130 and 136 are nearer than 7
    assert [r.at for r in ys] == [102, 133, 160, 200] and {(r.top, r.bottom) for r in ys} == {(100, 200)}
    xs = lambda *x: [r.at for r in ruled.column_rules(rules(spark, x, []), ["p"]).orderBy("at").collect()]
    assert xs(0, 5, 100, 200, 300, 400, 490, 500) == [5, 100, 200, 300, 400, 500]
    assert xs(0, 5, 100, 200) == [0, 5, 100, 200] and xs(0, 100) == []


def test_dense_rules_are_the_rows(spark):
    none = spark.createDataFrame([], WORD)
    got = ruled.ruled_cells(rules(spark, (0, 50, 100, 150), (0, 20, 40, 60, 80, 100)), none, ["p"])
    assert edges(got) == [(a, a + 20) for a in range(0, 100, 20)] and {r.way for r in got.collect()} == {"rules"}
    # one gap that is far wider than the others tells that the rules are not the rows; without text there are none
    assert ruled.ruled_cells(rules(spark, (0, 50, 100, 150), (0, 20, 40, 60, 80, 300)), none, ["p"]).count() == 0
    assert ruled.ruled_cells(rules(spark, (0, 50, 100, 150), ()), none, ["p"]).count() == 0


def test_rows_between_lines_of_text_stop_at_a_gap(spark):
    words = [word(i, 20, y, "x") for i, y in enumerate((145, 175, 205, 400))] + [word(9, 400, 150, "right of the frame")]
    got = ruled.ruled_cells(rules(spark, (0, 100, 200, 300), (100, 130, 600)), spark.createDataFrame(words, WORD), ["p"])
    # half-way between lines 30 apart; the table ends half a gap below its last line, and 212 leaves 8 to that end
    assert edges(got) == [(100, 130), (130, 160), (160, 190), (190, 212), (212, 220)] and {r.way for r in got.collect()} == {"text"}


def test_rows_between_item_numbers(spark):
    xs = (0, 20, 100, 200, 300, 400, 500, 600)
    numbers = [word(i, 2, y, t, 12.0, float(c)) for i, (y, t, c) in enumerate(((150, "1", 90), (170, "7", 90), (190, "2", 90), (230, "3", 90), (250, "4", 30)))]
    text = [word(20 + i, 110, y, "text") for i, y in enumerate((150, 166, 190, 206, 230, 246))]
    got = ruled.ruled_cells(rules(spark, xs, (100, 130, 600)), spark.createDataFrame(numbers + text, WORD), ["p"])
    assert edges(got) == [(100, 130), (130, 170), (170, 210), (210, 250)] and {r.way for r in got.collect()} == {"numbers"}
    wide = ruled.ruled_cells(rules(spark, (0, 200, *xs[2:]), (100, 130, 600)), spark.createDataFrame(numbers + text, WORD), ["p"])
    assert {r.way for r in wide.collect()} == {"text"}  # the first column is no gutter


def plain_chain(rows):
    best = ()
    for i, first in enumerate(rows):
        chain = [first]
        for nxt in rows[i + 1 :]:
            if nxt[1] - chain[-1][1] >= 8 and nxt[0] == chain[-1][0] + 1:
                chain.append(nxt)
        key = (len(chain), sum(c for *_, c in chain))
        if not best or key > best[0]:
            best = (key, chain)
    return best[1]


def test_serial_chains_equal_a_plain_search(spark):
    rng = random.Random(4)
    given = [(p, i, rng.randint(1, 6), float(i * rng.choice([3, 9, 12])), float(rng.randint(60, 99))) for p in range(30) for i in range(25)]
    got = layout.serial_chain(spark.createDataFrame(given, "p int, word_idx int, value long, y0 double, conf double"), ["p"]).orderBy("p", "place").collect()
    for p in range(30):
        own = sorted(((v, y, c, i) for q, i, v, y, c in given if q == p), key=lambda r: (r[1], r[3]))
        chain = plain_chain([r[:3] for r in own])
        found = [(r.value, r.y0, r.conf) for r in got if r.p == p]
        assert (len(found), sum(c for *_, c in found)) == (len(chain), sum(c for *_, c in chain))
        assert all(b[0] == a[0] + 1 and b[1] - a[1] >= 8 for a, b in zip(found, found[1:], strict=False))


def test_even_rules_and_modal_grids(spark):
    at = lambda *ys, **kw: [r.at for r in ruled.even_rules(rules(spark, [], ys), ["p"], F.lit(1000), **kw).orderBy("at").collect()]
    assert at(0, 4, 100, 200, 300) == [2, 100, 200, 300]
    assert at(0, 100, 110, 200, 300) == [0, 110, 200, 300] and at(0, 100) == [0, 100] and at() == []
    cells = [(1, r, 10.0 + 100 * c + r, 90.0 + 100 * c + r, 50.0 * r, 50.0 * r + 20) for r in range(3) for c in range(3 if r < 2 else 2)]
    got = ruled.modal_grid(spark.createDataFrame(cells, "p int, r int, x0 double, x1 double, y0 double, y1 double"), ["p"], F.lit(300.0)).orderBy("r", "c").collect()
    assert [(r.r, r.c, r.x0, r.x1, r.y0, r.y1) for r in got if r.r == 2] == [(2, 0, 8.0, 100.0, 100.0, 120.0), (2, 1, 100.0, 200.0, 100.0, 120.0), (2, 2, 200.0, 292.0, 100.0, 120.0)] and len(got) == 9


def table_words(p=1, first=0, top=100, heads=("Item", "Qty", "Amount"), body=(("pen", "2", "3.00"), ("cup", "1", "9.50"), ("bag", "4", "8"))):
    rows = [heads, *body]
    return [word(first + 10 * i + j, x, top + 20 * i, t, p=p) for i, row in enumerate(rows) for j, (x, t) in enumerate(zip((10, 200, 400), row, strict=True))]


def cells_of(df, p=1):
    return {(r.r, r.c): r.text for r in df.collect() if r.p == p}


def test_word_tables_choose_their_headings(spark):
    decoy = table_words(first=500, top=700, heads=("Name", "Phone", "City"), body=(("Al", "5551234", "Bonn"), ("Bo", "5551235", "Ulm")))
    got = cells_of(word_tables.word_tables(spark.createDataFrame(table_words() + decoy, WORD), ["p"]))
    assert got == {(0, 0): "Item", (0, 1): "Qty", (0, 2): "Amount", (1, 0): "pen", (1, 1): "2", (1, 2): "3.00", (2, 0): "cup", (2, 1): "1", (2, 2): "9.50", (3, 0): "bag", (3, 1): "4", (3, 2): "8"}
    short = word_tables.word_tables(spark.createDataFrame(table_words(body=(("pen", "2", "3.00"),)), WORD), ["p"])
    assert short.count() == 0  # one row is no table
    apart = table_words() + [word(900, 10, 400, "pad"), word(901, 200, 400, "5"), word(902, 400, 400, "1.00")]
    assert len(cells_of(word_tables.word_tables(spark.createDataFrame(apart, WORD), ["p"]))) == 12  # the gap ends it


def test_words_of_a_line_part_at_gaps_and_kinds(spark):
    line = [word(0, 0, 10, "+49 30 1234567", 100.0), word(1, 101, 10, "a@b.de", 60.0), word(2, 300, 10, "x", 20.0), word(3, 325, 10, "y", 20.0)]
    got = word_tables.line_groups(ruled.text_lines(spark.createDataFrame(line, WORD), ["p"]), ["p"]).orderBy("word_idx").collect()
    assert len({r.part for r in got}) == 3 and got[2].part == got[3].part and len({r.line for r in got}) == 1
    joined = spark.createDataFrame([([(0.0, 1, "قلم"), (50.0, 2, "ازرق")],), ([(50.0, 2, "pen"), (0.0, 1, "(blue")],), ([],)], "w array<struct<x:double,i:long,text:string>>")
    assert [r.t for r in joined.select(word_tables.joined_words(F.col("w")).alias("t")).collect()] == ["ازرق قلم", "blue pen", ""]


def test_a_counting_column_is_repaired(spark):
    grid = lambda *v: spark.createDataFrame([(1, i + 1, 0, t, 80.0) for i, t in enumerate(v)], "p int, r int, c int, text string, conf double")
    fix = lambda *v: [(r.text, r.conf) for r in word_tables.counted_column(grid(*v), ["p"]).orderBy("r").collect()]
    assert fix("1", "2", "8", "4", "5") == [("1", 80.0), ("2", 80.0), ("3", 55.0), ("4", 80.0), ("5", 80.0)]
    assert fix("1", "2", "8", "9", "5")[2][0] == "8" and fix("1", "2", "8", "4")[2][0] == "8" and fix("1", "2", "x", "4", "5")[2][0] == "x"


def region_list(words, lines=(), spark=None):
    regions, cells = pages.layout_document(spark.createDataFrame(list(words), WORD), spark.createDataFrame(list(lines), "p int, x double, y0 double, y1 double"), ["p"])
    return [r.asDict() for r in regions.orderBy("region").collect()], {(r.region, r.r, r.c): (r.text, r.conf) for r in cells.collect()}


def test_regions_of_a_page(spark):
    words = [word(0, 10, 20, "Prices"), word(1, 10, 5000, ".", 3.0, 10.0), *table_words(first=10, top=36)]
    regions, cells = region_list(words, spark=spark)
    assert [(r["kind"], r["title"], r["n_columns"], r["n_rows"]) for r in regions] == [("table", "Prices", 3, 3)]
    assert cells[0, -1, 1] == ("Qty", 90.0) and cells[0, 2, 2] == ("8", 90.0) and len(cells) == 12
    assert region_list([], spark=spark) == ([], {})


def test_rules_and_white_space_both_part_columns(spark):
    near = [w for i in range(4) for w in (word(10 * i, 10, 20 * i, f"a{i}", 50.0), word(10 * i + 1, 61, 20 * i, f"{i}.00", 50.0), word(10 * i + 2, 200, 20 * i, f"{i}.50", 50.0))]
    cut = lambda *x: [(1, float(v), -10.0, 80.0) for v in x]
    assert region_list(near, spark=spark)[0][0]["n_columns"] == 2
    assert region_list(near, cut(60.5), spark)[0][0]["n_columns"] == 3
    assert region_list(near, cut(60.5, 63.0), spark)[0][0]["n_columns"] == 3  # the second one is within a word's edge, and the same edge
    assert region_list(near, cut(80.0), spark)[0][0]["n_columns"] == 2 and region_list(near, [(1, 60.5, -10.0, 20.0)], spark)[0][0]["n_columns"] == 2
    regions, cells = region_list(near, cut(60.5), spark)
    assert cells[0, 3, 1][0] == "3.00" and regions[0]["kind"] == "table"


def test_arabic_pages_are_read_from_the_right(spark):
    rows = [w for i in range(2) for w in (word(10 * i, 10, 20 * i, "سعر"), word(10 * i + 1, 200, 20 * i, "قلم"), word(10 * i + 2, 243, 20 * i, "ازرق"), word(10 * i + 3, 400, 20 * i, "رقم"))]
    regions, cells = region_list(rows, spark=spark)
    assert regions[0]["direction"] == "rtl" and [cells[0, 0, c][0] for c in range(3)] == ["رقم", "ازرق قلم", "سعر"]


@pytest.mark.parametrize(
    ("en", "ar", "want"),
    [(("3", 0.22), ("يم", 0.8), ("3", "latin")), (("Name", 0.9), ("اسم", 0.8), ("Name", "latin")), (("Narne", 0.5), ("اسم", 0.5), ("اسم", "ar")), (("12", 0.5), ("١٢", 0.75), ("١٢", "ar")), (("12", 0.6), ("١٢", 0.75), ("12", "latin")),
     (("ab", 0.5), ("AB", 0.7), ("AB", "latin")), (("ab", 0.6), ("AB", 0.75), ("ab", "latin")), (("", 0.0), ("", 0.0), ("", "und")), ((None, None), ("سعر", 0.4), ("سعر", "ar")), (("x", 0.1), (None, None), ("x", "latin"))],
)
def test_choice_of_recognisers(spark, en, ar, want):
    df = spark.createDataFrame([(*en, *ar)], "e string, ec double, a string, ac double")
    r = df.select(choices.choose_box(F.col("e"), F.col("ec"), F.col("a"), F.col("ac")).alias("r")).first().r
    assert (r.text, r.script) == want


def test_scores_of_readings(spark):
    df = spark.createDataFrame([("12", 40.0, "qty", False, ""), ("x", 90.0, "qty", False, ""), ("Price", -1.0, "", True, "unit_price"), ("=a~", 50.0, "", False, ""), ("", 99.0, "qty", False, "")], "t string, c double, f string, h boolean, n string")
    got = [r.s for r in df.select(choices.reading_score(F.col("t"), F.col("c"), F.col("f"), F.col("h"), F.col("n")).alias("s")).collect()]
    assert got == pytest.approx([140.0, 10.0, 105.0, 30.7, -1000.0])
    page = spark.createDataFrame([("Invoice total $1.50",), (None,)], "t string").select(choices.page_score(F.col("t")).alias("s")).collect()
    assert [r.s for r in page] == [2 * 50 + 20 + 15, 0]


def items_of(spark, *lines, more=()):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((*lines, *more))], "p int, line_no int, text string")
    items, totals = free_items.free_items(df, ["p"])
    return [(r.description, r.qty, r.unit_price, r.total, r.conf, r.review) for r in items.orderBy("item_no").collect()], totals.first()


def test_items_below_their_labels(spark):
    got, _ = items_of(spark, "Item 2", "3", "$ 4.00", "|=", "12.00", "Item 1", "2", "1.50", "Tem 3", "7", "nothing here", "Item 4 2 $5.00 $10.00")
    assert got == [("Item 1", 2.0, 1.5, 3.0, 70.0, True), ("Item 2", 3.0, 4.0, 12.0, 88.0, False), ("Item 4", 2.0, 5.0, 10.0, 90.0, False)]


def test_a_fold_emits_none_one_or_two_rows(spark):
    rows = spark.createDataFrame([(k, i, i % 3) for k in (1, 2) for i in range(7)] + [(None, 0, 2)], "k int, i int, n int")
    step = lambda state, n: [state.append(n), [(n, len(state))] * n][1]
    got = folds.fold_many(rows, ["k"], ["i"], ["n"], list, step, lambda state: [(-1, len(state))], "n int, at int").collect()
    each = [(1, 2), (2, 3), (2, 3), (1, 5), (2, 6), (2, 6), (-1, 7)]
    assert sorted((r.n, r.at) for r in got if r.k == 1) == sorted(each) == sorted((r.n, r.at) for r in got if r.k == 2) and sorted((r.n, r.at) for r in got if r.k is None) == [(-1, 1), (2, 1), (2, 1)]


@pytest.mark.parametrize(
    ("figures", "want"),
    [(("10", "1500", "150.00"), (10.0, 15.0, 150.0, 90.0, False)), (("2", "5.00", None), (2.0, 5.0, 10.0, 70.0, True)), (("2", "5.00", "11.00"), (2.0, 5.0, 11.0, 55.0, True)), (("10", "10.00", "5100"), (10.0, 10.0, 100.0, 60.0, True)), (("2022", "5.00", "1"), None), (("0", "5.00", "0"), None), (("x", "1", "1"), None), (("3", "1200", "12.00"), (3.0, 12.0, 12.0, 90.0, True))],
)
def test_figures_of_an_item(figures, want):
    found = free_items.item_of("Item 1", *figures, 90.0)
    if want and want[0] == 3.0:  # a total below its price is what the reading lost points of
        assert found and found[1] == 3.0
    else:
        assert (found and found[1:]) == want


def test_prices_are_mended_by_the_subtotal(spark):
    got, totals = items_of(spark, "Item 1 x2 @ $1500", "Item 2 x1 @ $2000", more=("Sub Total $50.00", "Tax (10%) $5.00", "Total $55.00"))
    assert [g[1:] for g in got] == [(2.0, 15.0, 30.0, 65.0, True), (1.0, 20.0, 20.0, 65.0, True)]
    assert (totals.subtotal, totals.tax_amount, totals.grand_total, totals.currency) == (50.0, 5.0, 55.0, "USD")


def test_items_between_bars(spark):
    lines = ("scan.pdf Item 9 9 $9.00 $81.00", "blue pen | 3 | $4.00 | $12.00", "Description | Qty | $ | $1.00", "2 $ 7.50 x $15.00")
    got, totals = items_of(spark, *lines)
    assert [g[:4] for g in got] == [("blue pen", 3.0, 4.0, 12.0), ("Item 2", 2.0, 7.5, 15.0)] and totals.invoice_number is None
    got, totals = items_of(spark, *lines, "INV-20231 beside")  # beside a real number only labelled items count
    assert [g[0] for g in got] == ["Item 2"] and totals.invoice_number == "INV-20231"
    assert items_of(spark, "no items at all")[0] == []


def test_payload_of_three_tables(spark):
    html = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    items = html(("Description", "Qty", "Price", "Total"), ("desk lamp", "2", "3.00", "6.00"), ("note pad", "1", "4.00", "4.00"), ("pen holder", "3", "2.00", "6.00"))
    blocks = [(1, 0, "text", "Total: 99.00\nSupplier: (stamp"), (1, 1, "table", items), (1, 2, "table", html(("paper clip", "5", "1.00", "5.00"))), (1, 3, "table", html(("Subtotal", "21.00"), ("Total", "21.00"))), (1, 4, "table", html(("Invoice No", "A-7"), ("Discount", "1.50"))), (2, 0, "text", "nothing")]
    got = assembly.payload(spark.createDataFrame(blocks, "doc_id int, block_idx int, kind string, content string"))
    assert [(r.item_no, r.grid, r.row, r.description, r.qty, r.unit_price, r.line_total) for r in got.items.orderBy("item_no").collect()] == [
        (1, 1, 1, "desk lamp", 2, 3, 6), (2, 1, 2, "note pad", 1, 4, 4), (3, 1, 3, "pen holder", 3, 2, 6), (4, 2, 0, "paper clip", 5, 1, 5)]
    assert {r.key: (r.value, r.source) for r in got.totals.collect()} == {"subtotal": (21, "totals"), "grand_total": (21, "totals"), "discount": (1.5, "pair")}
    header = {r.key: (r.value, r.source) for r in got.header.where("doc_id = 1").collect()}
    assert header["invoice_number"] == ("A-7", "table") and "supplier" not in header  # a fragment is no name
    assert {(r.block_idx, r.kind) for r in got.grids.collect()} == {(1, "items"), (2, "more"), (3, "totals"), (4, "other")}


def test_medians_from_bins_equal_sorting(spark):
    from millrace.operators import headers

    rng = random.Random(6)
    given = [(k, str(rng.choice([rng.randint(-50, 50), round(rng.uniform(0, 1e6), 2), 7]))) for k in ("a", "b", None) for _ in range(201 if k else 40)] + [("c", "word"), ("d", "")]
    got = {r.k: r.upper_median for r in headers.column_stats(spark.createDataFrame(given, "k string, text string"), ["k"]).collect()}
    for key in ("a", "b", None):
        values = sorted(abs(float(t)) for k, t in given if k == key)  # a cell's sign does not count
        assert got[key] == pytest.approx(values[len(values) // 2])
    assert got["c"] == 0.0 and "d" not in got


def test_a_run_clears_its_tables(spark):
    from pathlib import Path

    from millrace import session

    here = lambda: {p.name for p in Path(session.shared_dir(spark).removeprefix("file:").replace("///", "/").replace("//", "/")).iterdir()}
    before = here()
    with session.run_folder(spark) as folder:
        kept = session.materialise(spark.range(5), "five")
        assert kept.count() == 5 and here() - before == {folder.rsplit("/", 1)[1]}
    assert here() == before and spark.conf.get(session.RUN, None) is None


def test_grids_that_words_do_not_bear_out(spark):
    cells = spark.createDataFrame([(1, r, c, 100.0 * c, 100.0 * c + 90, 30.0 * r, 30.0 * r + 25) for r in range(4) for c in range(3)], "p int, r int, c int, x0 double, x1 double, y0 double, y1 double")
    rows = lambda n, extra=0: [word(10 * r + c, 100 * c + 5, 30 * r + 12, f"{r}{c}") for r in range(n) for c in range(3)] + [word(500 + i, 900, 30 * i, "far") for i in range(extra)]
    judge = lambda words: ruled.accepted_grids(spark.createDataFrame(words, WORD), cells, ["p"])
    texts, grids = judge(rows(3, 8))
    assert grids.first().accepted and {(r.r, r.c): r.text for r in texts.collect()} == {(r, c): f"{r}{c}" for r in range(3) for c in range(3)}
    assert not judge(rows(2))[1].first().accepted  # half of the rows
    assert not judge(rows(3, 9))[1].first().accepted  # nine words outside
    assert not judge([word(0, 900, 10, "far")])[1].first().accepted
