import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, numbers, text


@pytest.fixture
def over(spark):
    def run(f, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]

    return run


def test_identifiers(over):
    got = over(lambda c: text.clean_cell(c, "shipment id"), ["O46620", "CMP-95-O0", "SHP-O5119-l", None, "", "Il-Bern"])
    assert got == ["046620", "CMP-95-00", "SHP-05119-1", "", "", "11-Bern"]
    assert over(lambda c: text.clean_cell(c, "weight"), ["197.67 tons"]) == ["197.67 tons"]


def test_numeric_fields_read_confusable_letters(over):
    assert over(lambda c: text.clean_cell(c, "qty"), ["1O", "l2", "lO oranges", " ٣ "]) == ["10", "12", "lO oranges", "3"]


def test_cells_are_collapsed(over):
    assert over(text.collapse, ["  a*!b  c ", "[x]%", "a \tb"]) == ["a b c", "x", "a b"]


def test_headings_fold(over):
    assert over(text.fold_header, ["الكمية", "الكميه", "أحمد", "QTY ", "إجمـالي"]) == ["الكميه", "الكميه", "احمد", "qty", "اجمالي"]


def test_dates(over):
    given = ["17/09/2015", "2015-9-7", "12/31/2015", "31/02/2015", "17/09/15", "17.09.2015", "٢٠١٥-٠٩-١٧", "abc", "", None]
    assert over(dates.normalize_date, given) == ["2015-09-17", "2015-09-07", "2015-12-31", "31/02/2015", "2015-09-17", "2015-09-17", "2015-09-17", "abc", "", None]


def test_normalized_numbers(over):
    assert over(numbers.normalize_number, ["1,234.50", "1.234,50", "1.234.567", "12 345", "abc", ""]) == ["1234.50", "1234.50", "1234567", "12 345", "abc", ""]


def test_numeric_cells(over):
    given = ["AED 25 000", "222 555 7777", "12,34,567", "(25)", "5%", "$1,234.50", "Dell 5664", "١٢٣", "1.5 SAR", "", "SAKAR GAS STONE 1,", "٣٫٥"]
    assert over(numbers.numeric_cell, given) == [25000, None, 1234567, 25, 5, 1234.5, None, 123, 1.5, None, None, 3.5]


def test_percent_and_identifiers(over):
    assert [(r["num"], r["raw"]) for r in over(numbers.percent_aware, ["5%", "7", "x"])] == [(0.05, None), (7.0, None), (None, "x")]
    assert over(numbers.plain_number, ["1234567", "123456", "1,234,567"]) == [None, 123456, 1234567]


def test_numbers_in_text(over):
    assert over(numbers.number_in, ["Subtotal: 820.00", "-5 x", "none", "1,234"]) == [820, -5, None, 1234]
    assert over(numbers.ocr_number, ["4.998.00", "1 2", "x 12,000.50", ""]) == ["4998.00", "", "12000.50", ""]


def test_currency(over):
    assert over(numbers.currency_code, ["$25", "10 AED", "x", "5 eur"]) == ["USD", "AED", None, "EUR"]
    assert over(text.currency_format, ["USD", "AED", ""]) == ['"$"#,##0.00', '#,##0.00" AED"', "#,##0.00"]


def test_lines(over):
    assert over(text.split_line, ["Order No: 12    Date: 2020-01-01", "a | b", "at 12:30 now", ""]) == [["Order No", "12", "Date", "2020-01-01"], ["a", "b"], ["at 12:30 now"], []]
    assert over(text.line_to_cells, ["a\tb\t", "a  b   c", "a b"]) == [["a", "b", ""], ["a", "b", "c"], ["a b"]]


def test_html(over):
    assert over(text.html_text, ["<p>a &amp; b</p><div>c<br>d</div>", None, "&lt;x&gt;"]) == ["a & b\nc\nd", "", "<x>"]


def test_names_phones_and_ocr(over):
    assert over(text.is_name, ["Acme (UK)", "ab", "(x) y", "12345", None]) == [True, False, False, False, False]
    assert over(text.phone_digits, ["+1 (743) 555-3824", "12", "٠٥٠١٢٣٤٥٦٧"]) == ["+17435553824", None, "0501234567"]
    assert over(text.tidy_numeric, ["1,234.5", "1.234,5", "S5O.2", "4.998.00"]) == ["1234.5", "1234.5", "550.2", "4998.00"]
    assert over(text.looks_numeric, ["12.5", "1O5", "12/05/2020", "ab1", "x", None]) == [True, True, False, False, False, False]


def test_nearness_is_relative_to_the_right(spark):
    row = spark.range(1).select(numbers.near(F.lit(100.4), F.lit(100.0)), numbers.near(F.lit(1.0), F.lit(1.03)), numbers.near(F.lit(1.0), F.lit(1.019))).first()
    assert list(row) == [True, False, True]


def test_json(over):
    assert over(text.json_of, ['```json\n{"a": 1,}\n```', "none"]) == ['{"a": 1}', None]


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([("1",)], "v string")
    plan = df.select(text.clean_cell(F.col("v"), "qty"), numbers.numeric_cell(F.col("v")), dates.normalize_date(F.col("v")), text.html_text(F.col("v")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert math.isfinite(1)
