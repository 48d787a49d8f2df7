"""Choosing between readings of one box, cell or page. Column expressions only.

Two recognisers of one box do not give equal evidence: the English one cannot write Arabic, so its output never proves that a box is
Latin, while Latin output of the Arabic one does. A figure cannot be Arabic letters, however sure the Arabic reading is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import ocr_number
from ..functions.text import looks_numeric, tidy_numeric, western_digits
from ..functions.vocab import ARABIC_DIGIT, ARABIC_LETTER, CHOICE_FIELDS, FIGURE_ONLY, NUMERIC_FIELDS, PAGE_TOKENS

#: How much surer Arabic digits, and how little surer Latin of the Arabic recogniser, must be.
DIGIT_LEAD, LATIN_LEAD = 0.25, 0.15


def choose_box(en: Column, en_conf: Column, ar: Column, ar_conf: Column) -> Column:
    """(text, conf, script: ar, latin or und) of a box that both recognisers have read."""
    en, ar = F.coalesce(en, F.lit("")), F.coalesce(ar, F.lit(""))
    english = F.struct(en.alias("text"), en_conf.alias("conf"), F.lit("latin").alias("script"))
    arabic = lambda script: F.struct(ar.alias("text"), ar_conf.alias("conf"), (F.lit(script) if isinstance(script, str) else script).alias("script"))
    letters = ar.rlike(ARABIC_LETTER)
    return (
        F.when((en == "") & (ar == ""), F.struct(F.lit("").alias("text"), F.lit(0.0).alias("conf"), F.lit("und").alias("script")))
        .when(en == "", arabic(F.when(letters, "ar").otherwise("latin")))
        .when(ar == "", english)
        .when(~letters & ar.rlike(ARABIC_DIGIT) & (ar_conf >= en_conf + DIGIT_LEAD), arabic("ar"))
        .when(~letters & (en_conf + LATIN_LEAD >= ar_conf), english)
        .when(~letters, arabic("latin"))
        .when(en.rlike(FIGURE_ONLY), english)
        .when(ar_conf >= en_conf, arabic("ar"))
        .otherwise(english)
    )


def _digitish(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[\p{Nd}$SsOoIl]"))


def _tidied(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "|=~«»", "     "), r"(?U)\s+", " "), r"^[ \-_,;:()]+|[ \-_,;:()]+$", "")
    return F.when(looks_numeric(c), tidy_numeric(plain)).otherwise(plain)


def choose_cell(first: Column, second: Column, places: Column, dirty: str) -> Column:
    """The text of a cell that was read with its page and again by itself: the second reading counts only with at least as many
    digits, and if it has the column's decimal places where the first has not, or is clean where the first matches ``dirty``."""
    first, second = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    a, b = _tidied(first), _tidied(second)
    fits = lambda t: F.coalesce((places > 0) & t.rlike(r"^-?\d+\.\d+$") & (F.length(F.substring_index(t, ".", -1)) == places), F.lit(False))
    return (
        F.when((b == "") | (_digitish(second) < _digitish(first)), first)
        .when(fits(b) & ~fits(a), second)
        .when(fits(a) & ~fits(b), first)
        .when(first.rlike(dirty) & ~b.rlike(dirty), second)
        .otherwise(first)
    )


def reading_score(text: Column, conf: Column, field: Column, heading: Column, canonical: Column) -> Column:
    """How good a reading of a cell is. Figures are wanted in numeric fields (field), known names (canonical) and letters in headings
    (heading: boolean), letters without marks elsewhere; an empty text is worse than all."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    sure = F.greatest(F.lit(0.0), conf)
    figure = ocr_number(text).rlike(r"^-?\d+(?:[.,]\d{1,3})?$") | western_digits(text).rlike(r"^-?\d+(?:[.,]\d{1,3})?$")
    arabic, letters = count("[؀-ۿ]"), count(r"\p{L}")
    named = F.when(canonical.isin(*CHOICE_FIELDS), 100.0).otherwise(0.0) + F.least(count(r"[\p{L}؀-ۿ]"), F.lit(18))
    plain = F.least(arabic + letters, F.lit(24)) * 0.7 - F.least(count(r"[=~\[\]]"), F.lit(4)) * 10
    rest = F.when(heading, named).otherwise(plain)
    return F.when(text == "", -1000.0).when(field.isin(*NUMERIC_FIELDS), sure + F.when(F.coalesce(figure, F.lit(False)), 100.0).otherwise(-80.0)).otherwise(sure + rest)


def page_score(text: Column) -> Column:
    """How much of an invoice a page's text holds: 50 for each of its words, 20 for each sum, 1 for each letter or digit."""
    text = F.coalesce(text, F.lit(""))
    words, sums, signs = (F.regexp_count(text, F.lit(p)) for p in PAGE_TOKENS)
    return words * 50 + sums * 20 + signs


def best_of(readings: Column, score: Column) -> Column:
    """Aggregate: of the readings (a struct that starts with its number) the one with the best score, the first of equal ones."""
    return F.max_by(readings, F.struct(score, -readings.getField("reading")))
