"""Fill-in-middle: whole texts cut at two line boundaries and put together for infilling.

The boundaries of a text (the offsets, in code points, where a line ends, and 0) are kept as a compressed set in the
manner of Roaring: offsets with equal high 16 bits share a container, which holds their low 16 bits as a sorted array, a bitmap or
runs, whichever is smallest, beside the number of offsets in all containers before it. The n-th boundary is found by a search of
those numbers for its container and a selection inside it, so both cuts come from two lookups, and a set of very many
boundaries stays small.

The cuts and the form are drawn from a hash of the doc_id, so reruns and retries agree. Each row is handled by itself: nothing is
shuffled.

Defined results: a null or empty text has no lines, is plain and stays empty; a text that contains a sentinel is plain, for its output could
not be taken apart; a null doc_id is hashed as an empty one; texts of any length are cut whole; repeated rows give repeated results;
cuts that fall together give an empty middle; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import arrow_rows, ids_as_long, ids_as_text

SEED = 7
#: Of 100 documents so many are rearranged, and of 100 of these so many have their suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets that share their high bits; an array is no larger than a bitmap up to 4,096 of them.
SPAN, DENSE = 1 << 16, 4096


class Container:
    """Sorted distinct numbers below 65,536 as an array, a bitmap or runs; ``select(i)`` is the i-th of them."""

    def __init__(self, low: np.ndarray):
        low = low.astype("int64")
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        runs = len(starts)
        if 4 * runs < min(2 * len(low), SPAN // 8):
            self.kind = "run"
            self.first, self.before = low[starts].astype("<u2"), starts.astype("<u2")  # numbers in the runs before each
        elif len(low) <= DENSE:
            self.kind, self.numbers = "array", low.astype("<u2")
        else:
            self.kind = "bitmap"
            bits = np.zeros(SPAN, "u1")
            bits[low] = 1
            self.words = np.packbits(bits, bitorder="little").view("<u8")
            self.upto = np.cumsum(np.bitwise_count(self.words), dtype="int64")

    def select(self, i: int) -> int:
        if self.kind == "array":
            return int(self.numbers[i])
        if self.kind == "run":
            run = int(np.searchsorted(self.before, i, "right")) - 1
            return int(self.first[run]) + i - int(self.before[run])
        word = int(np.searchsorted(self.upto, i, "right"))
        inside = np.unpackbits(self.words[word : word + 1].view("u1"), bitorder="little")
        skip = i - (int(self.upto[word - 1]) if word else 0)
        return word * 64 + int(np.flatnonzero(inside)[skip])


class BoundarySet:
    """Ascending distinct offsets in containers by their high bits, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPAN
        self.high, first = np.unique(high, return_index=True)
        edges = np.append(first, len(offsets))
        self.upto = edges[1:]
        self.containers = [Container(offsets[i:j] % SPAN) for i, j in zip(edges, edges[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, i: int) -> int:
        """The i-th offset, from 0."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        c = int(np.searchsorted(self.upto, i, "right"))
        return int(self.high[c]) * SPAN + self.containers[c].select(i - (int(self.upto[c - 1]) if c else 0))


def line_ends(text: str) -> np.ndarray:
    """0 and the offset behind each line, a last one without its newline included."""
    lengths = np.fromiter(map(len, text.split("\n")), "int64") + 1
    ends = np.cumsum(lengths)
    ends[-1] -= 1  # the last line has no newline
    if len(ends) > 1 and ends[-1] == ends[-2] or not text:
        ends = ends[:-1]
    return np.concatenate([[0], ends])


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the doc_id."""
    code = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(code[i : i + 8], 16) for i in (0, 8, 16, 24))


def infilled(text: str, doc_id: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """n (lines), form, code points of prefix and middle (None if plain), output."""
    ends = BoundarySet(line_ends(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = ends.select(a), ends.select(b)
    if h4 % 100 < suffix_first:
        return n, "spm", i, j - i, f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"
    return n, "psm", i, j - i, f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    one, found, rest = output[len(first) :].partition(second)
    two, ended, middle = rest.partition(MIDDLE)
    if not found or not ended:
        raise ValueError(f"no {form} output")
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output, restored (the text that
    is rebuilt from output and form alone)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [infilled(t or "", i or "", seed, rate, suffix_first) for t, i in zip(batch["text"], batch["doc_id"], strict=True)]
            found = pd.DataFrame(done, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            found = found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found.assign(restored=[restored(o, f) for o, f in zip(found["output"], found["form"], strict=True)])

    arrow_rows(docs.sparkSession)
    schema = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return ids_as_long(ids_as_text(docs, "text").mapInPandas(run, schema))
