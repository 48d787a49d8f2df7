"""Cleaning of cell text. Everything is a Column expression; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import DATE_FIELD, EASTERN_DIGITS, ID_FIELD, LABEL_VALUE, NUMBER_FIELD, WESTERN_DIGITS

_SPACE = r"(?U)\s+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def western_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits as 0 to 9."""
    return F.translate(c, EASTERN_DIGITS, WESTERN_DIGITS)


def collapse(c: Column) -> Column:
    """Null as empty, symbol runs and white space as one space, no space at the ends, western digits."""
    return western_digits(_trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[*!%\[\]]+", " "), _SPACE, " ")))


def _unconfuse(c: Column) -> Column:
    return F.translate(c, "OoIl", "0011")


def correct_identifier(c: Column, field: str = "") -> Column:
    """O and 0, I or l and 1 told apart in each part between hyphens that is mostly digits."""
    import re

    if re.search("(?i)date|تاريخ", field) and not re.search(ID_FIELD.replace("(?iU)", "(?i)"), field):
        return c

    def part(p: Column) -> Column:
        doubtful = F.length(p) - F.length(F.translate(p, "OoIl", ""))
        digits = F.length(p) - F.length(F.regexp_replace(p, r"(?U)\d", ""))
        letters = F.length(p) - F.length(F.regexp_replace(p, r"\p{L}", "")) - doubtful
        keep = (digits + doubtful == 0) | ((letters > 0) & (letters > digits + doubtful))
        return F.when(keep, p).otherwise(_unconfuse(p))

    return F.array_join(F.transform(F.split(c, "-", -1), part), "-")


def clean_cell(c: Column, field: str = "") -> Column:
    """A cell's text as its field wants it: identifiers corrected; in numeric fields, confusable letters
    of figures as digits."""
    import re

    text = collapse(c)
    if re.search(ID_FIELD.replace("(?iU)", "(?i)"), field):
        return correct_identifier(text, field)
    if re.search(NUMBER_FIELD.replace("(?iU)", "(?i)"), field):
        return F.when(text.rlike(r"(?U)^[0-9OoIl.,\s/+-]+$"), _unconfuse(text)).otherwise(text)
    return text


def is_date_field(name: Column) -> Column:
    return name.rlike(DATE_FIELD)


def fold_header(c: Column) -> Column:
    """A heading with the spellings of alef, yeh and teh marbuta made equal, and no tatweel."""
    return F.translate(F.lower(collapse(c)), "أإآىةـ", "ااايه")


def tidy_ocr(c: Column) -> Column:
    """OCR text without stray marks, white space collapsed, punctuation cut off at the ends."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"[|~`^_«»•°¬]+", " ")
    text = _trim(F.regexp_replace(text, _SPACE, " "))
    return F.regexp_replace(text, r"^[\s.,;:'\"\-\u064B-\u0652]+|[\s,;:'\"\-\u064B-\u0652]+$", "")


def looks_numeric(c: Column) -> Column:
    """A figure, perhaps misread: no two letters together, no Arabic, no date, and mostly digits."""
    digits, letters = F.regexp_count(c, F.lit(r"\d")), F.regexp_count(c, F.lit("[A-Za-z]"))
    plain = ~c.rlike("[A-Za-z]{2}") & ~c.rlike(r"[\u0600-\u06FF]") & ~c.rlike(r"\d{1,4}[/-]\d{1,2}[/-]\d{1,4}")
    return F.coalesce(plain & (digits >= 1) & (letters <= F.greatest(F.lit(1.0), digits / 3)), F.lit(False))


def tidy_numeric(c: Column) -> Column:
    """A figure's text with glyphs read as digits and only its last decimal point."""
    text = western_digits(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, ""))
    us = text.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
    eu = text.rlike(r"^\d{1,3}(\.\d{3})+,\d+$")
    other = F.translate(text, "OoIlSsB$:", "00115585.")
    other = F.regexp_replace(F.regexp_replace(other, r"[^0-9.\-]", ""), r"\.(?=.*\.)", "")
    other = F.regexp_replace(other, r"(?<=.)-", "")
    return F.when(us, F.translate(text, ",", "")).when(eu, F.translate(F.translate(text, ".", ""), ",", ".")).otherwise(other)


def arabic_share(c: Column) -> Column:
    """Share of Arabic letters among letters; 0 without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"[\u0600-\u06FF&&\p{L}]")).cast("double"), letters), F.lit(0.0))


def direction(c: Column, threshold: float = 0.5) -> Column:
    return F.when(arabic_share(c) > threshold, "rtl").otherwise("ltr")


def split_pair(c: Column) -> Column:
    """(label, value) of one "label: value"; null if it is none, or a clock time."""
    label, value = F.regexp_extract(c, LABEL_VALUE, 1), F.regexp_extract(c, LABEL_VALUE, 2)
    good = c.rlike(LABEL_VALUE) & label.rlike(r"\p{L}") & ~c.rlike(r"\d:\d")
    return F.when(good, F.struct(label.alias("label"), value.alias("value")))


def split_line(c: Column, most: int = 8) -> Column:
    """Cells of a printed line: chunks between tabs, bars or runs of spaces, labels parted from values."""
    chunks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\t|\||\s{2,}"), _trim), lambda x: x != "")

    def cells(x: Column) -> Column:
        pair = split_pair(x)
        return F.when(pair.isNull(), F.array(x)).otherwise(F.array(pair["label"], pair["value"]))

    return F.slice(F.flatten(F.transform(chunks, cells)), 1, most)


def line_to_cells(c: Column) -> Column:
    """A line as a table row: tabs, else runs of at least two spaces, else one cell."""
    wide = F.filter(F.transform(F.split(c, r" {2,}"), _trim), lambda x: x != "")
    return F.when(c.contains("\t"), F.transform(F.split(c, "\t"), _trim)).when(c.rlike(r"\S {2,}\S"), wide).otherwise(F.array(_trim(c)))


def is_name(c: Column) -> Column:
    """At least three characters, a letter, no opening mark first, brackets balanced."""
    count = lambda mark: F.regexp_count(c, F.lit(mark))
    balanced = (count(r"\(") == count(r"\)")) & (count(r"\[") == count(r"\]"))
    return F.coalesce((F.length(c) >= 3) & c.rlike(r"\p{L}") & ~c.rlike(r"^[(\[{.,;:\-]") & balanced, F.lit(False))


def is_noise(c: Column, confidence: Column) -> Column:
    """A word to drop: short, unsure, and without letter or digit."""
    return (F.length(c) <= 2) & (confidence < 30) & ~c.rlike(r"(?U)[\p{L}\p{N}]")


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Visible text of an HTML fragment: breaks and ends of blocks as newlines, tags as spaces, the common
    entities decoded, white space collapsed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>|</p\s*>|</div\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    return _trim(F.regexp_replace(text, r"(?U)\s*\n\s*", "\n"))


def safe_name(c: Column, most: int = 120) -> Column:
    """The last part of a path, printable, without reserved characters."""
    base = F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/\\]*)$", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(base, r"\p{Cntrl}", ""), r'[<>:"|?*]', ""), 1, most)


def phone_digits(c: Column) -> Column:
    """Digits and a leading plus of a telephone number of 8 to 15 digits, else null."""
    bare = F.regexp_replace(western_digits(c), r"[^0-9+]", "")
    return F.when(bare.rlike(r"^\+?\d{8,15}$"), bare)


def fingerprint(c: Column, most: int = 400) -> Column:
    """16 hexadecimal digits of the SHA-1 of the folded beginning of a layout's heading text."""
    folded = _trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SPACE, " "))
    return F.substring(F.sha1(F.encode(F.substring(folded, 1, most), "UTF-8")), 1, 16)


EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
URL = r"(?i)https?://|www\."
PHONE = r"\+?\d[\d ()-]{7,}\d"


def signals(c: Column) -> dict[str, Column]:
    """Numbers of e-mail addresses, links and telephone-like runs."""
    text = F.coalesce(c, F.lit(""))
    return {"emails": F.regexp_count(text, F.lit(EMAIL)), "urls": F.regexp_count(text, F.lit(URL)), "phones": F.regexp_count(text, F.lit(PHONE))}


def join_words(words: Column, rtl: Column) -> Column:
    """Words (array of struct x0, text) joined in reading order."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(F.when(rtl, -w["x0"]).otherwise(w["x0"]).alias("at"), w["text"].alias("text"))))
    return _trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda w: w["text"]), " "), _SPACE, " "))


def currency_format(code: Column) -> Column:
    """A number format that shows a currency's sign before, or its code behind, the figure."""
    sign = F.create_map(*[F.lit(x) for kv in (("USD", "$"), ("EUR", "€"), ("GBP", "£"), ("JPY", "¥"), ("CNY", "¥"), ("INR", "₹"), ("CAD", "$"), ("AUD", "$"), ("TRY", "₺")) for x in kv])[F.upper(code)]
    bare = F.substring(F.regexp_replace(F.coalesce(code, F.lit("")), r'["\;\[\]]', ""), 1, 6)
    return F.when(sign.isNotNull(), F.concat(F.lit('"'), sign, F.lit('"#,##0.00'))).when(bare == "", F.lit("#,##0.00")).otherwise(F.concat(F.lit('#,##0.00" '), bare, F.lit('"')))


def json_of(c: Column) -> Column:
    """The outermost JSON object in a text, trailing commas dropped."""
    body = F.translate(F.regexp_extract(c, r"(?s)(\{.*\})", 1), "“”", '""')
    return F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit(""))
