from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.operators import documents, geometry, headers, html, jobs, master, reconcile, repair, roles, rows


def sheet(spark, lines):
    return spark.createDataFrame([("f", 0, i, list(c)) for i, c in enumerate(lines)], "source string, sheet_idx int, row_idx int, cells array<string>")


def test_blank_rows_and_columns(spark):
    got = rows.drop_empty_columns(sheet(spark, [["", "a", ""], [" "], ["", "", "", "b"]]), ["source"]).orderBy("row_idx").collect()
    assert [r.cells for r in got] == [["a", ""], ["", "b"]]


def test_first_of_equal_rows_stays(spark):
    got = rows.dedupe_rows(sheet(spark, [["a", "b"], ["x"], ["a", "b"], ["x", ""], ["a\x1fb"]])).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == [0, 1, 3, 4]


def test_empty_tables(spark):
    none = sheet(spark, []) if False else spark.createDataFrame([], "source string, sheet_idx int, row_idx int, cells array<string>")
    assert rows.dedupe_rows(rows.drop_blank_rows(none)).count() == 0
    assert headers.find_header_rows(none, ["source"]).count() == 0


def test_header_fold_needs_a_clear_lead(spark):
    lines = [["Report", ""], ["Invoice No", "Date", "Qty"], ["Invoice No", "Date", "Qty"], ["7", "2020-01-01", "3"]]
    assert headers.find_header_rows(sheet(spark, lines), ["source"]).first().header_row == 1
    assert headers.find_header_rows(sheet(spark, [["a@b.com", "http://x.y"], ["1", "2"]]), ["source"], reliable=True).first().header_row is None
    assert headers.find_header_rows(sheet(spark, [["1", "2", "3"], ["4", "5", "6"]]), ["source"]).first().header_row == 0


def test_headings(spark):
    given = [("Quantiy",), ("الكميه",), ("Unit Price (AED)",), ("zzz",), ("",), (None,)]
    got = {r.h: r.canonical for r in headers.canonical_headers(spark.createDataFrame(given, "h string"), "h").collect()}
    assert got == {"Quantiy": "qty", "الكميه": "qty", "Unit Price (AED)": "unit_price", "zzz": "zzz", "": "column", None: "column"}


def test_unique_headings(spark):
    given = spark.createDataFrame([(1, 0, "Amount"), (1, 1, "amount"), (1, 2, " "), (1, 3, "AMOUNT")], "t int, position int, name string")
    assert [r.name for r in rows.unique_headings(given, ["t"]).orderBy("position").collect()] == ["Amount", "amount (2)", "column_3", "AMOUNT (3)"]


def test_the_quantity_that_multiplies_wins(spark):
    lines = [("widget one", 9, 2, 10.0), ("widget two", 9, 3, 20.0), ("widget six", 8, 4, 5.5)]
    cells = [(1, r, c, str(v)) for r, (d, decoy, q, p) in enumerate(lines) for c, v in enumerate((d, decoy, q, f"{p:.2f}", f"{q * p:.2f}"))]
    heads = [(1, c, h) for c, h in enumerate(("Description", "Quantity", "Quantity", "Price", "Amount"))]
    got = roles.assign_roles(spark.createDataFrame(cells, "doc_id long, r int, c int, text string"), spark.createDataFrame(heads, "doc_id long, c int, heading string")).collect()
    assert {r.role: r.c for r in got} == {"description": 0, "qty": 2, "unit_price": 3, "line_total": 4}
    assert {r.agreement for r in got} == {1.0}


def test_unrelated_numbers_get_no_roles(spark):
    cells = [(1, r, c, str((r + 3) * (c + 5) * 7 % 91)) for r in range(4) for c in range(4)]
    heads = [(1, c, f"x{c}") for c in range(4)]
    got = roles.assign_roles(spark.createDataFrame(cells, "doc_id long, r int, c int, text string"), spark.createDataFrame(heads, "doc_id long, c int, heading string"))
    assert got.where("role IN ('qty', 'unit_price', 'line_total')").count() == 0


def test_totals(spark):
    stated = spark.createDataFrame([(1, 1, "Total", 820.0), (1, 2, "VAT", 123.0), (1, 3, "Total", 943.0), (1, 4, "Amount paid", 943.0)], "doc_id long, pos int, label string, amount double")
    got = reconcile.resolve_totals(stated).first()
    assert (got.subtotal, got.tax_amount, got.grand_total, got.amount_paid) == (820, 123, 943, 943)


def test_row_kinds(spark):
    given = [["", " "], ["Section", "", ""], ["Total:", "", "5.00"], ["Desk", "2", "5.00"]]
    got = sheet(spark, given).orderBy("row_idx").select(reconcile.row_kind(F.col("cells")).alias("k")).collect()
    assert [r.k for r in got] == ["blank", "section", "total", "item"]


def one(spark, q, p, t, evidence=None):
    items = spark.createDataFrame([(q, p, t, evidence)], "qty double, unit_price double, line_total double, seen array<double>")
    return repair.repair_items(items, F.col("seen") if evidence is not None else None).first()


def test_repairs_need_one_explanation(spark):
    assert one(spark, 3.0, 2500.0, 75000.0).fixed_unit_price == 25000
    assert one(spark, 2.0, 5.0, 10.0).repaired_field is None
    bad = one(spark, 2.0, 5.0, 987.0)
    assert bad.repaired_field is None and bad.review
    seen = one(spark, 13.0, 12.0, 36.0, [3.0, 12.0, 36.0])
    assert (seen.repaired_field, seen.fixed_qty) == ("qty", 3)


def test_readings(spark):
    got = spark.range(1).select(repair.from_alternatives(F.lit(13.0), F.array(F.lit(17.0), F.lit(3.0)), F.lit(12.0), F.lit(36.0)), repair.from_alternatives(F.lit(13.0), F.array(F.lit(17.0)), F.lit(12.0), F.lit(36.0)), repair.quantity_from_total(F.lit(None).cast("double"), F.lit(2.5), F.lit(10.0))).first()
    assert list(got) == [3.0, 13.0, 4.0]


def test_fuzzy_master(spark):
    lists = [("f", n) for n in ("Acme", "Globex Corporation", "Alpha Suppliers", "Alpha Supplied")]
    values = [("f", n) for n in ("Acmee", "Alpha Supplie", "Globex Corporatio", "Nothing", "Acme", "")]
    got = {r.value: (r.status, r.match) for r in master.fuzzy(spark.createDataFrame(values, "field string, value string"), spark.createDataFrame(lists, "field string, value string")).collect()}
    assert got["Acmee"] == ("matched", "Acme") and got["Acme"] == ("exact", "Acme") and got["Globex Corporatio"][1] == "Globex Corporation"
    assert got["Alpha Supplie"][0] == "ambiguous" and got["Nothing"] == ("none", None) and got[""][0] == "none"


def test_fuzzy_master_finds_all_that_brute_force_finds(spark):
    import random

    random.seed(5)
    entries = sorted({"".join(random.choice("abcde ") for _ in range(random.randint(3, 18))).strip() or "a" for _ in range(80)})
    values = []
    for _ in range(60):
        t = list(random.choice(entries))
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(t))
            t[i : i + 1] = random.choice([[], ["x"], [t[i], "b"]])
            t = t or ["a"]
        values.append("".join(t))
    found = master.fuzzy(spark.createDataFrame([("f", v) for v in values], "field string, value string"), spark.createDataFrame([("f", e) for e in entries], "field string, value string"))
    assert {r.value: (r.status, r.match, r.ratio, r.runner_up) for r in found.collect()} == {v: plain_match(v, entries) for v in values}


def plain_match(value, entries):
    """Status, match, ratio and runner-up of a value against all entries."""
    if value in entries:
        return "exact", value, 1.0, None
    close = sorted(((SequenceMatcher(None, e, value).ratio(), e) for e in entries), reverse=True)
    close = [e for r, e in close if r >= 0.88][:2]
    if not close:
        return "none", None, None, None
    ratios = [SequenceMatcher(None, value.casefold(), e.casefold()).ratio() for e in close]
    ambiguous = len(close) > 1 and ratios[0] - ratios[1] < master.FUZZY_MARGIN
    return "ambiguous" if ambiguous else "matched", close[0], ratios[0], close[1] if len(close) > 1 else None


def test_fuzzy_master_query_against_brute_force(spark):
    from millrace.plans import invoices

    sf = "/root/testdata/sf0.001"
    lists = {"part": [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().collect()], "supplier": [r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_name").distinct().collect()]}
    got = invoices.fuzzy_master(spark, sf).collect()
    assert got
    for r in got:
        assert (r.status, r.match, r.ratio, r.runner_up) == plain_match(r.value, lists[r.field]), r


def test_grounding(spark):
    numbers = spark.createDataFrame([(1, 1234.5), (1, 7.0), (2, 5.0), (1, 12.34)], "page int, value double")
    evidence = spark.createDataFrame([(1, 1234.5), (1, 991234.0)], "page int, seen double")
    got = {(r.page, r.value): r.grounded for r in master.ground_numbers(numbers, evidence, "page").collect()}
    assert got == {(1, 1234.5): True, (1, 7.0): False, (2, 5.0): None, (1, 12.34): True}


def test_grounding_against_brute_force(spark):
    import random

    random.seed(9)
    figure = lambda: round(random.choice([random.random() * 10, random.random() * 1e4, random.randrange(10**11) / 100, 0.0]), 2)
    evidence = [(g, figure()) for g in (1, 2) for _ in range(60)]
    numbers = [(g, v) for g, v in evidence[:20]] + [(g, figure()) for g in (1, 2, 3) for _ in range(60)]
    numbers += [(g, float(f"{v:.2f}"[1:])) for g, v in evidence if v >= 100]
    got = {(r.page, r.value): r.grounded for r in master.ground_numbers(spark.createDataFrame(numbers, "page int, value double"), spark.createDataFrame(evidence, "page int, seen double"), "page").collect()}
    run = lambda v: f"{v:.2f}".replace(".", "").lstrip("0")
    want = {(g, v): None if g == 3 else any(run(v) in run(e) for h, e in evidence if h == g) for g, v in numbers}
    assert got == want and {True, False, None} <= set(got.values())


def test_html_spans():
    got = html.grid("<table><tr><th>A<th colspan=2>B<tr><td rowspan='2'>x<td>1<td>2<tr><td>3<td>4<tr><td>&nbsp;</table>")
    assert [[c[0] for c in r] for r in got] == [["A", "B", ""], ["x", "1", "2"], ["x", "3", "4"]]
    assert [c[3] for c in got[2]] == [True, False, False] and html.grid(None) == []


def test_blocks(spark):
    got = spark.createDataFrame([("a<table><tr><td>1</td></tr></table>b<table></table>",)], "h string").select(html.blocks(F.col("h")).alias("b"), html.simple_rows(F.col("h")).alias("r")).first()
    assert [b.kind for b in got.b] == ["text", "table", "text", "table"] and got.r == [["1"]]


def test_stacked_headings(spark):
    tables = spark.createDataFrame([(1, "<tr><td>Item<td colspan=2>Charges<tr><td><td>Freight<td>Tax<tr><td>x<td>1.00<td>2.00"), (2, "<tr><td>a<td>b<tr><td>c<td>d")], "t int, html string")
    got = html.header_band(html.table_cells(tables, ["t"]), ["t"]).orderBy("c").collect()
    assert [(r.t, r.heading) for r in got] == [(1, "Item"), (1, "Charges"), (1, "Charges")] or [(r.t, r.heading) for r in got] == [(1, "Item"), (1, "Charges Freight"), (1, "Charges Tax")]


def test_lines_and_overlaps(spark):
    words = spark.createDataFrame([(1, 0, "a", 90.0, 0.0, 10.0, 0.0, 10.0), (1, 1, "b", 80.0, 20.0, 30.0, 2.0, 12.0), (1, 2, "c", 70.0, 0.0, 10.0, 30.0, 40.0), (1, 3, "d", 60.0, 1.0, 10.0, 0.0, 10.0)], "page int, word_idx int, text string, conf double, x0 double, x1 double, y0 double, y1 double")
    assert {r.word_idx: r.line for r in geometry.words_to_lines(words, ["page"]).collect()} == {0: 0, 1: 0, 3: 0, 2: 1}
    assert {r.text: r.alternatives for r in geometry.suppress(words, ["page"]).collect()} == {"a": ["d"], "b": [], "c": []}


def boxed_words(n, page, seed):
    import random

    random.seed(seed)
    rows = []
    for i in range(n):
        x, y, h = random.random() * 400, random.random() * n, random.choice([4.0, 8.0, 11.5, 30.0, 400.0 if i % 97 == 0 else 9.0])
        rows.append((page, i, f"w{i}", round(random.random() * 100, 3), x, x + random.random() * 60, y, y + h))
    return rows


WORD = "page int, word_idx int, text string, conf double, x0 double, x1 double, y0 double, y1 double"


def test_long_pages_against_plain_loops(spark):
    """Two pages that span many Arrow batches, and one word alone."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = boxed_words(500, 1, 1) + boxed_words(300, 2, 2) + boxed_words(1, 3, 3)
        words = spark.createDataFrame(rows, WORD)
        lines = {(r.page, r.word_idx): r.line for r in geometry.words_to_lines(words, ["page"]).collect()}
        stay = {(r.page, r.word_idx): list(r.alternatives) for r in geometry.suppress(words, ["page"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for page in (1, 2, 3):
        own = [r for r in rows if r[0] == page]
        lasts = []
        for r in sorted(own, key=lambda r: ((r[6] + r[7]) / 2, r[1])):
            mid, height = (r[6] + r[7]) / 2, r[7] - r[6]
            at = next((i for i in range(len(lasts) - 1, -1, -1) if abs(mid - lasts[i][0]) <= min(height, lasts[i][1]) / 2), len(lasts))
            lasts[at : at + 1] = [(mid, height)]
            assert lines[page, r[1]] == at
        kept = []
        for r in sorted(own, key=lambda r: (-r[3], r[1])):
            area = lambda b: max((b[5] - b[4]) * (b[7] - b[6]), 1e-9)
            for k, texts in kept:
                shared = max(0, min(r[5], k[5]) - max(r[4], k[4])) * max(0, min(r[7], k[7]) - max(r[6], k[6]))
                if shared / min(area(r), area(k)) > 0.55:
                    texts.append(r[2])
                    break
            else:
                kept.append((r, []))
        assert {w: t for (p, w), t in stay.items() if p == page} == {k[1]: t for k, t in kept}


def test_words_meet_cells_columns_and_values_of_their_bands(spark):
    rows = boxed_words(200, 1, 4) + boxed_words(40, 2, 5)
    boxes = [(p, i, x0 - 20, x1 + 20, y0 - 10, y1 + 10) for p, i, _, _, x0, x1, y0, y1 in boxed_words(60, 1, 6)]
    words = spark.createDataFrame(rows, WORD)
    cells = spark.createDataFrame(boxes, "page int, cell_idx int, x0 double, x1 double, y0 double, y1 double")
    got = {(r.page, r.word_idx): r.cell_idx for r in geometry.words_to_cells(words, cells, ["page"]).collect()}
    columns = [(1, 0, 300.0), (1, 1, 100.0), (1, 2, 100.0), (1, 3, 200.0)]
    near = {(r.page, r.word_idx): r.column_idx for r in geometry.nearest_column(words, spark.createDataFrame(columns, "page int, column_idx int, x double"), ["page"]).collect()}
    labels = words.where("word_idx % 10 = 0").select("page", F.col("word_idx").alias("label_idx"), "x0", "y1")
    below = {(r.page, r.label_idx): r.value for r in geometry.value_below(labels, words, ["page"]).collect()}
    for p, i, _, _, x0, x1, y0, y1 in rows:
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        fit = [(abs(x - (b[2] + b[3]) / 2) + abs(y - (b[4] + b[5]) / 2), b[1]) for b in boxes if b[0] == p and b[2] - 3 <= x <= b[3] + 3 and b[4] - 3 <= y <= b[5] + 3]
        assert got[p, i] == (min(fit)[1] if fit else None)
        assert near[p, i] == min(((abs(x - c[2]), c[1]) for c in columns if c[0] == p), default=(0, None))[1]
        if i % 10 == 0:
            under = [(abs(r[4] - x0) + 0.35 * (r[6] - y1), r[1], r[2]) for r in rows if r[0] == p and 0 <= r[6] - y1 <= 78]
            assert below[p, i] == (min(under)[2] if under else None)


def test_pages_merge(spark):
    pages = spark.createDataFrame([("s", 1, "A", ["x"], 2), ("s", 2, None, ["x"], 1), ("s", 3, None, [], 0), ("s", 4, "B", ["x"], 1), ("s", 5, "B", ["y"], 1), ("s", 6, None, ["z"], 1)], "source string, page int, order_id string, columns array<string>, n_items int")
    assert [r.doc_no for r in documents.merge_pages(pages).orderBy("page").collect()] == [0, 0, 0, 1, 1, 2]


def test_rules_of_merging(spark):
    fields = spark.createDataFrame([(1, "k", "", 0, 0), (1, "k", "a", 1, 2), (1, "k", "b", 2, 1)], "doc_id int, key string, value string, o int, prio int")
    assert documents.first_wins(fields, ["doc_id"], "o").first().value == "a"
    assert documents.last_wins(fields, ["doc_id"], "o").first().value == "b"
    assert documents.by_precedence(fields, ["doc_id"]).first().value == "b"


def test_last_edit_wins(spark):
    cells = spark.createDataFrame([("o", "S", 1, 1, "a"), ("o", "S", 1, 2, "b")], "output string, sheet string, row int, column int, value string")
    edits = spark.createDataFrame([("O", "s", 1, 1, "x", 1), ("o", "s", 1, 1, None, 2)], "output string, sheet string, row int, column int, value string, edit_id int")
    assert {r.column: (r.value, r.edited) for r in jobs.apply_review(cells, edits).collect()} == {1: (None, True), 2: ("b", False)}


def test_alternatives_and_votes(spark):
    from millrace.operators import columns

    readings = spark.createDataFrame([(1, "a", 5.0), (1, "a", 9.0), (1, "b", 7.0), (1, "c", 7.0), (1, "d", 1.0)], "p int, text string, conf double")
    got = columns.alternatives(readings, ["p"]).first().alternatives
    assert [(a.text, a.conf) for a in got] == [("a", 9.0), ("b", 7.0), ("c", 7.0)]
    cells = spark.createDataFrame([(1, 0, 0, "$5"), (1, 0, 1, "AED 5"), (1, 1, 0, "x")], "d int, r int, c int, text string")
    assert columns.currency_vote(cells, ["d"]).first().currency == "USD"


def test_restored_decimals(spark):
    from millrace.operators import columns

    cells = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(("1.50", "2.25", "3.10", "499", "7"))], "d int, r int, c int, text string")
    assert {r.text: r.restored for r in columns.restore_decimals(cells, ["d"]).collect()} == {"1.50": "1.50", "2.25": "2.25", "3.10": "3.10", "499": "4.99", "7": "7"}


def test_field_pairs(spark):
    from millrace.operators import fields

    rows = spark.createDataFrame([(["Name: Bo", "Tel: 5"],), (["Total", "7"],), (["only"],), (["5", "6"],)], "cells array<string>")
    got = [[(p.label, p.value) for p in r.f] for r in rows.select(fields.field_pairs(F.col("cells")).alias("f")).collect()]
    assert got == [[("Name", "Bo"), ("Tel", "5")], [("Total", "7")], [], []]
    table = sheet(spark, [["Name", "City", "Zone"], ["Bo", "Oslo", "3"], ["x", "1"]])
    assert {(r.label, r.value) for r in fields.label_rows(table, ["source"]).collect()} == {("Name", "Bo"), ("City", "Oslo"), ("Zone", "3")}


def test_best_candidate_is_filled(spark):
    from millrace.operators import fields

    rows = spark.createDataFrame([(1, 2, {"a": "x", "b": ""}), (1, 1, {"a": "y", "b": "z"})], "d int, rank int, fields map<string,string>")
    assert fields.best_candidate(rows, ["d"]).first().fields == {"a": "x", "b": "z"}
    merged = spark.range(1).select(fields.overlay(F.create_map(F.lit("a"), F.lit("1"), F.lit("e"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"), F.lit("e"), F.lit("8"), F.lit("n"), F.lit("7")), ("e",)).alias("m")).first().m
    assert merged == {"a": "9", "e": "2", "n": "7"}


def test_layout_pieces(spark):
    from millrace.operators import layout

    sections = spark.createDataFrame([(1, 0, "text", "ACME"), (1, 1, "table", ""), (2, 0, "text", "two\nlines")], "p int, section int, kind string, text string")
    assert [(r.p, r.masthead) for r in layout.masthead(sections, ["p"]).collect()] == [(1, "ACME")]
    lines = spark.createDataFrame([(1, i, h) for i, h in enumerate((10.0, 10.0, 50.0, 10.0, 11.0, 9.0))], "p int, line int, height double")
    assert sorted(r.line for r in layout.uniform_rows(lines, ["p"]).collect()) == [0, 3, 4, 5]  # the longest even run, and the first row
    even = lines.withColumn("height", F.when(F.col("height") > 20, 13.0).otherwise(F.col("height")))
    assert layout.uniform_rows(even, ["p"]).count() == 6 and layout.uniform_rows(lines.where("line < 3"), ["p"]).count() == 3
    rules = spark.createDataFrame([(1, 0, 50.0, 0.0, 100.0), (1, 1, 22.0, 0.0, 100.0), (1, 2, 60.0, 0.0, 10.0)], "p int, rule_idx int, x double, y0 double, y1 double")
    block = spark.createDataFrame([(1, 0.0, 100.0, 0.0, 100.0)], "p int, x0 double, x1 double, y0 double, y1 double")
    words = spark.createDataFrame([(1, 10.0, 40.0, 10.0, 20.0)], "p int, x0 double, x1 double, y0 double, y1 double")
    assert [r.rule_idx for r in layout.clear_rules(rules, block, words, ["p"]).collect()] == [0]
    rows = spark.createDataFrame([(["Item", "Qty"],), (["Item", "5"],), (["one"],)], "cells array<string>")
    assert [r.h for r in rows.select(layout.layout_header(F.col("cells")).alias("h")).collect()] == [True, False, False]


def test_aligned_tables(spark):
    from millrace.operators import layout

    def row(page, line, *cells):
        return [(page, line * 10 + i, t, float(x), float(x + w), line * 30.0, line * 30.0 + 12) for i, (t, x, w) in enumerate(cells)]

    rows = row(1, 0, ("Item", 10, 40), ("Qty", 150, 40), ("Amount", 300, 40)) + row(1, 1, ("desk", 8, 40), ("2=9.50", 100, 300)) + row(1, 2, ("old", 10, 20), ("lamp", 40, 20), ("4", 295, 30))
    rows += row(2, 0, ("one", 10, 30)) + row(2, 1, ("two", 12, 30), ("|", 40, 5)) + row(3, 0, (" ", 0, 9))
    words = spark.createDataFrame(rows, "page int, word_idx int, text string, x0 double, x1 double, y0 double, y1 double")
    got = {(r.page, r.line, r.column_idx): r.text for r in layout.aligned_table(words, ["page"]).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0, 0): "Item", (1, 0, 1): "Qty", (1, 0, 2): "Amount", (1, 1, 0): "desk", (1, 1, 1): "2", (1, 1, 2): "9.50", (1, 2, 0): "old lamp", (1, 2, 2): "4"}
    assert {k: v for k, v in got.items() if k[0] != 1} == {(2, 0, 0): "one", (2, 1, 0): "two |"}
    assert layout.aligned_table(words.limit(0), ["page"]).isEmpty()


def test_accounts(spark):
    from millrace.operators import accounts

    plans = spark.createDataFrame([("a", True, 1, 5.0), ("b", False, 0, 9.0)], "slug string, active boolean, sort_order int, price double")
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz")], "user_id int, plan_slug string")
    assert {r.user_id: r.price for r in accounts.with_plan(users, plans).collect()} == {1: 5.0, 2: None, 3: None}
    assert accounts.known_plan(users, plans).count() == 2 and [p.slug for p in accounts.active_plans(plans).collect()] == ["a"]
    assert accounts.seed_plans(plans.limit(0), plans).count() == 2 and accounts.seed_plans(plans, plans).count() == 2
    given = spark.createDataFrame([("3: no page could be read", "FileNotFoundError", 503), ("x", "FileNotFoundError", 200), ("busy", "E", 429), ("both: fallback could not either", "E", None), (None, None, 400)], "m string, e string, s int")
    codes = given.select(accounts.failure_code(F.col("m"), F.col("e"), accounts.reader_gone(F.col("s"), F.col("m"))).alias("c")).collect()
    assert [r.c for r in codes] == ["no_page_read", "source_missing", "reader_unavailable", "reader_unavailable", "reader_failed"]


def test_layout_tables_of_many_lines(spark, tmp_path):
    from millrace.plans import layouts

    rows = spark.range(1, 1004).selectExpr("6L AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id AS l_partkey", "id + 5000 AS l_suppkey", "1.0D AS l_extendedprice", "DATE'2024-01-01' AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = layouts.layout_tables(spark, str(tmp_path)).collect()
    assert len({r.line for r in got}) == 1003 and len(got) == 3009
    assert sorted(r.text for r in got if r.column_idx == 1) == sorted(str(i + 5000) for i in range(1, 1004))


def test_layout_tables_of_many_cells_in_a_line(spark):
    from millrace.operators import layout

    words = spark.range(0, 2004).selectExpr("1 AS page", "CAST(id AS INT) AS word_idx", "concat('w', id) AS text", "90.0D AS conf", "(id % 1002) * 100.0D AS x0", "(id % 1002) * 100.0D + 20 AS x1", "floor(id / 1002) * 20.0D AS y0", "floor(id / 1002) * 20.0D + 12 AS y1")
    cells, _ = layout.tables_of_words(words, ["page"])
    assert {(r.line, r.column_idx): r.text for r in cells.collect()} == {(i // 1002, i % 1002): f"w{i}" for i in range(2004)}
