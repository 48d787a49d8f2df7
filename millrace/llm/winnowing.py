"""Winnowing fingerprints, in DataFrame operations only.

A text is cut into words (a character of a script without spaces is one), every ``GRAM`` neighbouring words are hashed,
and in each window of ``WINDOW`` such hashes the smallest is selected, the rightmost of equal ones. So
two texts that share a passage of ``GRAM + WINDOW - 1`` words share a selected hash, and no match is
shorter than ``GRAM`` words. The hash of a gram is made from hashes of its halves, each made once for
all the grams that hold it; the window minimums likewise. A selected hash and its position are packed
into one long, hash first and position inverted, so that the smallest long is the smallest hash with the
largest position.

Positions count up to 2**28 - 1 grams. Likeness is the Jaccard similarity of the sets of hashes.

Defined results: a null or empty text, or one of white space, has an empty fingerprint; two empty
fingerprints have likeness 1, an empty one and another 0; fewer words than a gram make one gram of all;
fewer grams than a window make one window; repeated rows of one doc_id follow one another in the order
of their texts; a null doc_id comes last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quantile_bounds, range_part

GRAM, WINDOW = 5, 16
_POSITION_BITS, _HASH_BITS = 28, 35
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
#: Anything beyond the scripts that come before Thai in Unicode: only such texts are searched for unspaced characters.
_FAR = r"[^\x00-\u0dff]"
#: Rows of one part of the id range, about.
PART_ROWS = 8_000


def units(text: Column) -> Column:
    """The words of a text, each character of an unspaced script being one."""
    text = F.coalesce(text, F.lit(""))
    spread = F.when(text.rlike(_FAR), F.regexp_replace(text, rf"([{_UNSPACED}])", " $1 ")).otherwise(text)
    return F.array_remove(F.split(spread, r"[\x20\x09-\x0D]+"), "")


def _pairs(a: Column, b: Column, shift: int, n: Column, step) -> Column:  # noqa: ANN001
    """step(a[i], b[i + shift]) for the first ``n`` i."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), step)


def winnow(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``out``: an array of packed longs in the order
    of their positions."""
    powers = [1 << i for i in range(gram.bit_length()) if 1 << i < gram]
    df = df.withColumn("_h1", F.transform(units(F.col(text)), lambda u: F.xxhash64(u)))
    n = F.size("_h1")
    mix = lambda a, b: F.xxhash64(a, b)
    have, names = 1, ["_h1"]
    for p in powers:  # hashes of 1, 2, 4, ... words
        if p * 2 <= gram:
            df = df.withColumn(f"_h{p * 2}", _pairs(F.col(f"_h{p}"), F.col(f"_h{p}"), p, n - (2 * p - 1), mix))
            have, names = p * 2, [*names, f"_h{p * 2}"]
    last = f"_h{have}"
    for p in sorted((int(x[2:]) for x in names), reverse=True):  # and of the rest of a gram
        if have + p <= gram:
            df = df.withColumn(f"_g{have + p}", _pairs(F.col(last), F.col(f"_h{p}"), have, n - (have + p - 1), mix))
            have, last, names = have + p, f"_g{have + p}", [*names, f"_g{have + p}"]
    whole = F.when(n > 0, F.array(F.xxhash64(F.to_json("_h1")))).otherwise(F.array().cast("array<bigint>"))
    grams = F.when(n >= gram, F.col(last)).otherwise(whole)
    top = (1 << _POSITION_BITS) - 1
    pack = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - _HASH_BITS), _POSITION_BITS).bitwiseOR(F.lit(top).cast("long") - i)
    df = df.withColumn("_m", F.transform(grams, pack)).withColumn("_n", F.size("_m")).drop(*names)
    reach = 1
    while reach < window:
        shift = min(reach, window - reach)
        df = df.withColumn("_m", F.zip_with("_m", F.slice("_m", F.lit(1 + shift), F.greatest(F.col("_n"), F.lit(0))), lambda a, b: F.least(a, b)))
        reach += shift
    df = df.withColumn("_m", F.slice("_m", F.lit(1), F.greatest(F.col("_n") - (window - 1), F.lit(1))))
    return df.withColumn(out, F.array_distinct("_m")).drop("_m", "_n")


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, _POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    """The positions of a fingerprint's hashes: the number of the gram's first word, from 0."""
    top = (1 << _POSITION_BITS) - 1
    return F.transform(fingerprint, lambda x: F.lit(top).cast("long") - x.bitwiseAND(F.lit(top).cast("long")))


def spelled(fingerprint: Column) -> Column:
    """The fingerprint as text: hexadecimal hash, colon, position; joined by commas."""
    top = (1 << _POSITION_BITS) - 1
    one = lambda x: F.concat(F.lower(F.hex(F.shiftright(x, _POSITION_BITS))), F.lit(":"), (F.lit(top).cast("long") - x.bitwiseAND(F.lit(top).cast("long"))).cast("string"))
    return F.array_join(F.transform(fingerprint, one), ",")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the Jaccard similarity of two arrays of hashes."""
    df = df.withColumn("_both", F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col("_both")
    return df.withColumn(out, F.when(union == 0, F.lit(1.0)).otherwise(F.col("_both") / union)).drop("_both")


def with_next(df: DataFrame, order: str, tie: str, columns: dict[str, str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with columns of the row that follows in descending ``order`` (nulls last), after the last
    the first; rows of equal order by ``tie``. ``columns``: column -> new name.

    The order is cut into parts at values that occur. A part is one window group; the row that follows its
    last is the first of the part before, whose value is known: it is the cut, so rows with a value that is
    a cut are sent to the next part as well.
    """
    spark = df.sparkSession
    head = df.select(order).agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("n")).first()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-head["n"] // part_rows))
    bounds = quantile_bounds(df.select(order), order, parts)
    key = F.col(order)
    part = range_part(key, bounds)
    cut = range_part(F.try_add(key, F.lit(1)), bounds) > part
    top = key.eqNullSafe(F.lit(head["top"]).cast("long"))
    seat = lambda p, kind: F.struct(p.cast("int").alias("part"), F.lit(kind).alias("kind"))
    seats = F.array_compact(F.array(seat(part, 0), F.when(cut, seat(part + 1, 1)), F.when(top, seat(F.lit(0), 2))))
    rows = df.select("*", F.explode(seats).alias("_seat"))
    w = Window.partitionBy("_seat.part").orderBy("_seat.kind", key.desc_nulls_last(), tie)
    return rows.select(*df.columns, F.col("_seat.kind").alias("_kind"), *[F.lead(c).over(w).alias(a) for c, a in columns.items()]).where("_kind = 0").drop("_kind")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text ('' for null) and fingerprint of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return winnow(rows, "text", "fingerprint", gram, window)


def compared(docs: DataFrame) -> DataFrame:
    """Each document against an edit of it, whose second half is the beginning of the next document, and
    against that document: doc_id, n_chars, edited, fingerprint, edited_fingerprint (arrays),
    near_edited, near_next."""
    rows = with_next(fingerprints(docs), "doc_id", "text", {"text": "_next", "fingerprint": "_next_fp"})
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    keep = (F.col("n_chars") - F.col("_half")).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("_next", F.lit(1), F.col("_half"))))
    rows = winnow(rows.drop("text", "_next", "_half"), "edited", "edited_fingerprint")
    rows = rows.withColumn("_a", hashes(F.col("fingerprint"))).withColumn("_b", hashes(F.col("edited_fingerprint"))).withColumn("_c", hashes(F.col("_next_fp")))
    rows = with_likeness(with_likeness(rows, "_a", "_b", "near_edited"), "_a", "_c", "near_next")
    return rows.drop("_a", "_b", "_c", "_next_fp")
