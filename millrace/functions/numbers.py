"""Figures in text. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _trim, western_digits
from .vocab import CURRENCY, MONEY, SYMBOL_CODES



def normalize_number(c: Column) -> Column:
    """Grouped figures without their separators and with a decimal point; other text as it is."""
    original = _trim(c)
    text = F.replace(western_digits(original), F.lit(" "), F.lit(""))
    plain = F.translate(text, ",", "")
    return (
        F.when(text == "", original)
        .when(text.rlike(r"^\d{1,6}(,\d{3})+(\.\d+)?$"), plain)
        .when(text.rlike(r"^\d{1,6}(\.\d{3})+(,\d+)?$"), F.translate(F.translate(text, ".", ""), ",", "."))
        .otherwise(western_digits(original))
    )


def _double(c: Column) -> Column:
    return F.when(c.rlike(r"^[-+]?\d+(\.\d+)?$"), c.try_cast("double"))


def number_in(c: Column) -> Column:
    """The first number anywhere in a text."""
    text = F.translate(F.translate(western_digits(c), "٫", "."), " ,٬", "")
    return _double(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1))


def number_after_label(c: Column) -> Column:
    """The first number of a text, white space allowed inside."""
    text = F.translate(western_digits(c), "٫", ".")
    return _double(F.regexp_replace(F.regexp_extract(text, r"(?U)(-?\d[\d,٬\s]*(?:\.\d+)?)", 1), r"(?U)[\s,٬]", ""))


def _bound(value: Column, of) -> Column:  # noqa: ANN001
    """``of(value)`` with the value computed once, however often ``of`` names it: generated code stays short."""
    return F.transform(F.array(value), of)[0]


def grouped_legally(digits: Column) -> Column:
    """Groups of three, or, South-Asian, of two before the last three; the first of one to three."""

    def legal(groups: Column) -> Column:
        rest = F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0)))
        middle = F.slice(groups, 2, F.greatest(F.size(groups) - 2, F.lit(0)))
        threes = F.forall(rest, lambda g: F.length(g) == 3)
        pairs = (F.length(F.try_element_at(groups, F.lit(-1))) == 3) & F.forall(middle, lambda g: F.length(g) == 2)
        return (F.size(groups) == 1) | (F.length(groups[0]).between(1, 3) & (threes | pairs))

    return _bound(F.split(digits, r"(?U)[,٬\s]"), legal)


def numeric_cell(c: Column) -> Column:
    """The value of a cell that is one figure, with a currency or percent sign perhaps; else null. Signs
    and brackets do not negate."""

    def value(figure: Column) -> Column:
        number = F.translate(F.regexp_replace(figure, r"(?U)[,٬\s]", ""), "٫", ".").try_cast("double")
        simple = figure.rlike(r"^\d*(?:\.\d+)?$")  # most figures have no groups to look at
        return F.when(figure != "", F.when(simple | grouped_legally(F.split(figure, "[.٫]")[0]), number))

    body = western_digits(_trim(F.coalesce(c, F.lit(""))))
    plain = F.when(c.rlike(r"^[0-9]{1,15}(?:\.[0-9]{1,9})?$"), c.try_cast("double"))  # most cells; the value below is the same
    return plain.when(c.rlike(r"(?U)\d"), _bound(F.regexp_extract(body, MONEY, 1), value))


def percent_aware(c: Column) -> Column:
    """(num, raw): 5% is 0.05; what is no number is kept as it is."""
    value = numeric_cell(c)
    num = F.when(_trim(c).endswith("%"), value / 100).otherwise(value)
    return F.struct(num.alias("num"), F.when(num.isNull(), c).alias("raw"))


def plain_number(c: Column) -> Column:
    """A cell's figure, unless it is an identifier: seven or more bare digits."""
    return F.when(~_trim(western_digits(c)).rlike(r"^\d{7,}$"), numeric_cell(c))


def ocr_number(c: Column) -> Column:
    """The text of the one number in a text, '' for none or several; of several points only the last
    counts."""
    found = F.regexp_extract_all(western_digits(F.coalesce(c, F.lit(""))), F.lit(r"\d[\d.,]*\d|\d"), F.lit(0))
    bare = F.regexp_replace(F.translate(found[0], ",", ""), r"\.(?=.*\.)", "")
    return F.when(F.size(found) == 1, bare).otherwise("")


def near(left: Column, right: Column, tolerance: float = 0.02) -> Column:
    """Within the tolerance, or within half a percent of the right one."""
    return F.abs(left - right) <= F.greatest(F.lit(tolerance), F.abs(right) * 0.005)


def currency_code(c: Column) -> Column:
    """The code of the first currency mark of a cell, null if none."""
    mark = _trim(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iU)({CURRENCY})", 1))
    codes = F.create_map(*[F.lit(x) for kv in SYMBOL_CODES.items() for x in kv])
    return F.when(mark != "", F.coalesce(codes[mark], F.upper(mark)))


def money_key(c: Column) -> Column:
    return F.format_string("%.2f", c)


def whole_numbers(c: Column) -> Column:
    """Aggregate: do all values have no fraction?"""
    return F.bool_and(c == F.floor(c))
