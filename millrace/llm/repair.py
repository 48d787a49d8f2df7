"""Token ids on disk in Re-Pair grammars.

Documents are tokenised and written in ascending doc_id order, in shards of about ``SHARD_TOKENS`` ids
(a document is never split over shards). A shard is compressed by Re-Pair: the frequent pairs of
neighbouring symbols are replaced by new symbols, again and again, and what is stored are the rules,
the expansion length of each rule, and the remaining symbols. The running sums of the expansion
lengths tell which symbols cover any stretch of ids, so one document is decoded without the rest.

A round of the grammar replaces many pairs at once: of those that are frequent in that round the more frequent one wins
where two overlap, and of a run of one symbol every other pair counts. Rounds go on, with ever less
frequent pairs, until no pair occurs twice. So there are as many rules as the ids need, and a passage
that is repeated becomes few symbols however long it is. Symbols are stored in two, three or four bytes.

The files are Parquet, a row for each shard, so that Spark's committer makes them whole and any store
can hold them. Parts of the id range are dealt to tasks by bounds from one scan of the ids.

Defined results: a null or empty text is the end id alone; repeated rows are written each; rows of
equal doc_id follow one another in the order of their texts; a null doc_id comes first; an empty table makes no
file rows; other columns are ignored; a long text makes a shard of its own length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, ids_as_long, materialise, quantile_bounds, range_part, scratch

SHARD_TOKENS = 1 << 19
#: In the first round the pairs are replaced that occur at least a SHARE-th as often as the most frequent one, and in each
#: further one those that occur at least half as often as in the round before.
SHARE = 3
#: Pairs are told apart by a hash of so many bits at least.
FEWEST_BITS = 14
#: Rows of one part of the id range, about: a task's share.
PART_ROWS = 8_000
#: Code points of texts that are tokenised together, about.
HEAP_CHARS = 8 << 20
#: Parts whose sums are broadcast; 16 MB.
SENT_PARTS = 1_000_000

_SHARD = "part int, shard int, start long, n_tokens long, doc_ids array<string>, doc_starts array<long>, base int, rules binary, lengths binary, width int, symbols binary"


def _idle(rest: np.ndarray) -> np.ndarray:
    """Those that don't count of the pairs ``rest`` (their numbers in order) that come after the same pair: of a run of one symbol
    every other pair counts."""
    run = np.flatnonzero(np.diff(rest, prepend=-2) != 1)
    turn = np.arange(len(rest)) - np.repeat(run, np.diff(np.append(run, len(rest))))
    return rest[turn % 2 == 0]


def _frequent(s: np.ndarray, least: int | None) -> tuple[int, np.ndarray, np.ndarray]:
    """The bound (if none is given, from the most frequent pair), the places of pairs that may occur so often, and those of pairs
    within runs. Counts by a hash of the pair are no less than the true ones; the higher the bound, the fewer slots tell pairs apart."""
    bits = max(10, len(s).bit_length())
    if least:
        bits = min(bits, max(FEWEST_BITS, bits + 2 - least.bit_length()))
    slot = s[:-1] * np.uint32(0x9E3779B1)
    slot += s[1:]
    slot *= np.uint32(0x85EBCA6B)
    slot >>= np.uint32(32 - bits)
    slot = slot.astype(np.intp)
    count = np.bincount(slot, minlength=1 << bits)
    same = s[1:] == s[:-1]
    runs = np.flatnonzero(same[1:] & same[:-1]) + 1
    idle = _idle(runs)
    np.subtract.at(count, slot[idle], 1)
    least = least or max(2, int(count.max()) // SHARE)
    often = (count >= least)[slot]
    often[idle] = False
    return least, np.flatnonzero(often), runs


def _grouped(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in ascending order, which of them each pair is, and how many there are of each. All symbols are below
    ``symbols``. Pairs are sorted with their places in one number where it has the bits."""
    n, wide, low = len(left), symbols.bit_length(), len(left).bit_length()
    keys = left.astype("uint64") << np.uint64(wide)
    keys |= right
    if 2 * wide + low <= 64:
        keys <<= np.uint64(low)
        keys |= np.arange(n, dtype="uint64")
        keys.sort()
        order = (keys & np.uint64((1 << low) - 1)).astype(np.intp)
        keys >>= np.uint64(low)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    which = np.empty(n, np.intp)
    which[order] = np.cumsum(new) - 1
    return np.stack([left[order[first]], right[order[first]]], 1), which, np.diff(np.append(first, n))


def _once(places: np.ndarray) -> np.ndarray:
    """The different places in order."""
    places = np.sort(places)
    return places[np.diff(places, prepend=-2) != 0]


def _ranks(many: np.ndarray, least: int) -> np.ndarray:
    """More for the more frequent pair, each its own; 0 for those that occur less than ``least`` times."""
    rank = np.empty(len(many), "int32")
    rank[np.argsort(many, kind="stable")] = np.arange(1, len(many) + 1)
    rank[many < least] = 0
    return rank


def _replace(s: np.ndarray, base: int, least: int | None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
    """One round over all symbols: the symbols after it, its rules (pairs), its bound, and, if that is 2, the places of all pairs that
    may still occur twice."""
    n = len(s)
    least, some, runs = _frequent(s, least)
    pairs, which, many = _grouped(s[some], s[some + 1], base)
    mine = _ranks(many, least)[which]
    apart = some[1:] != some[:-1] + 1
    wins = mine > 0
    wins[1:] &= apart | (mine[1:] > mine[:-1])
    wins[:-1] &= apart | (mine[1:] < mine[:-1])
    wins = np.flatnonzero(wins)  # numbers are faster than flags
    at, won = some[wins], which[wins]
    used = np.bincount(won, minlength=len(pairs))
    fit = used[won] >= 2
    at, won = at[fit], won[fit]
    out, keep = s.copy(), np.ones(n, bool)
    out[at] = base + (np.cumsum(used >= 2) - 1)[won]
    keep[at + 1] = False
    rules = pairs[used >= 2]
    if least > 2:
        return out[np.flatnonzero(keep)], rules, least, None
    place = np.cumsum(keep) - 1
    old = np.concatenate([some[mine > 0], runs])
    new = place[at]
    left = _once(np.concatenate([place[old[keep[old]]], new, new - 1]))
    out = out[keep]
    return out, rules, least, left[(left >= 0) & (left < len(out) - 1)]


def _rest(s: np.ndarray, base: int, open_: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rounds of bound 2 after the first one: the symbols after them, and the rules of each. ``open_`` holds the places, in order,
    of all pairs that may occur twice. A round works on such places alone: symbols keep their places, each knows those after and
    before it, and place ``n`` is that of none."""
    n = len(s)
    s = np.append(s, np.uint32(0xFFFFFFFF))
    after, before = np.minimum(np.arange(1, n + 2), n), np.arange(-1, n)
    before[0] = n
    weight, known, keep, rules = np.zeros(n + 1, "int32"), np.zeros(n + 1, bool), np.ones(n + 1, bool), []
    keep[n] = False
    while len(open_):
        left, right = s[open_], s[after[open_]]
        follows = (left == right) & (left == s[before[open_]])
        known[open_] = True
        started = before[open_[follows]]
        started = started[~known[started]]
        known[open_] = False
        if len(started):  # of a run all places are needed to tell which of them count
            open_ = _once(np.concatenate([open_, started]))
            continue
        rest, alone = np.flatnonzero(follows), np.ones(len(open_), bool)
        alone[_idle(rest)] = False
        some = open_[alone]
        pairs, which, many = _grouped(left[alone], right[alone], base)
        mine = weight[some] = _ranks(many, 2)[which]
        wins = (mine > 0) & (mine > weight[before[some]]) & (mine > weight[after[some]])
        weight[some] = 0
        at, won = some[wins], which[wins]
        used = np.bincount(won, minlength=len(pairs))
        fit = used[won] >= 2
        at, won = at[fit], won[fit]
        if not len(at):
            break
        s[at] = base + (np.cumsum(used >= 2) - 1)[won]
        rules.append(pairs[used >= 2])
        base += len(rules[-1])
        gone = after[at]
        keep[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        open_ = _once(np.concatenate([some[mine > 0], open_[rest], at, before[at]]))
        open_ = open_[keep[open_] & (after[open_] < n)]
    return s[keep], rules


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """ids -> (base, rules, lengths, symbols): symbol base + i stands for the pair rules[i], which
    expands to lengths[i] ids."""
    s = ids.astype("uint32")
    base = int(s.max()) + 1 if len(s) else 0
    rules, made, least, bound = [np.empty((0, 2), "uint32")], 0, None, 0
    while len(s) >= 4 and bound != 2:
        s, new, bound, open_ = _replace(s, base + made, least)
        rules.append(new)
        made, least = made + len(new), max(2, bound // 2)
        if bound == 2 and len(new):
            s, more = _rest(s, base + made, open_)
            rules += more
    lengths, made = np.ones(base + sum(map(len, rules)), "int64"), base
    for new in rules:
        lengths[made : made + len(new)] = lengths[new[:, 0]] + lengths[new[:, 1]]
        made += len(new)
    return base, np.concatenate(rules), lengths[base:], s


def width_of(symbols: int) -> int:
    """Bytes in which so many symbols are told apart."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


def packed(symbols: np.ndarray, width: int) -> bytes:
    return symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :width].tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 4), "u1")
    wide[:, :width] = np.frombuffer(raw, "u1").reshape(-1, width)
    return wide.view("<u4").ravel()


def _flat(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The expansions of all rules one after the other, and where each begins. Rules are expanded together as far as
    they need none of each other."""
    begin = np.concatenate([[0], np.cumsum(lengths, dtype="int64")])
    out = np.empty(int(begin[-1]), "uint32")
    need = np.maximum.accumulate(rules.max(1).astype("int64") - base) if len(rules) else np.empty(0, "int64")
    first = 0
    while first < len(rules):
        last = int(np.searchsorted(need, first, "left"))
        at = begin[first:last].copy()
        for side in (0, 1):
            symbol = rules[first:last, side].astype("int64")
            compound = symbol >= base
            out[at[~compound]] = symbol[~compound]
            rule = symbol[compound] - base
            size = lengths[rule].astype("int64")
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at[compound], size) + step] = out[np.repeat(begin[rule], size) + step]
            moved = np.ones(len(symbol), "int64")
            moved[compound] = size
            at += moved
        first = last
    return out, begin[:-1]


def expand(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``, a level of rules at a time."""
    s = symbols
    while len(s) and (compound := s >= base).any():
        at = np.cumsum(1 + compound) - (1 + compound)
        out = np.empty(len(s) + int(compound.sum()), s.dtype)
        pair = rules[s[compound] - base]
        out[at[~compound]] = s[~compound]
        out[at[compound]], out[at[compound] + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


class Shard:
    """A shard's row, for decoding stretches of it."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, width: int, symbols: bytes):
        self.base = base
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, "<u4")
        self.symbols = unpacked(symbols, width)
        compound = self.symbols >= base
        each = np.ones(len(self.symbols), "int64")
        each[compound] = self.lengths[self.symbols[compound] - base]
        self.ends = np.cumsum(each)

    def all(self) -> np.ndarray:
        """All ids, each symbol copied from the expansions of all rules."""
        flat, begin = _flat(self.base, self.rules, self.lengths)
        letters = int(self.base)
        source = np.concatenate([np.arange(letters, dtype="uint32"), flat])  # ids stand for themselves
        begins = np.concatenate([np.arange(letters), letters + begin])[self.symbols]
        each = np.diff(self.ends, prepend=0)
        return source[np.repeat(begins - (self.ends - each), each) + np.arange(int(each.sum()))]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` of the shard to ``stop``, by expanding only the symbols there."""
        if start >= stop:
            return np.empty(0, "uint32")
        lo = int(np.searchsorted(self.ends, start, "right"))
        hi = int(np.searchsorted(self.ends, stop, "left")) + 1
        before = int(self.ends[lo - 1]) if lo else 0
        return expand(self.base, self.rules, self.symbols[lo:hi])[start - before : stop - before]


def _heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together until their texts have ``HEAP_CHARS``: words are looked up once for all of them."""
    held: list[pd.DataFrame] = []
    chars = 0
    for batch in batches:
        held.append(batch)
        chars += sum(map(len, filter(None, batch["text"].tolist())))
        if chars >= HEAP_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, chars = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def write(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS, part_rows: int = PART_ROWS) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the shards to ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows))
    bounds = quantile_bounds(rows, "doc_id", parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokens import encoder

        known = encoder(tokenizer)
        part, shard, start, size = None, 0, 0, 0
        ids: list[bytes] = []
        owners: list[str | None] = []

        def close() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(ids), "<u4")
            base, rules, lengths, symbols = compress(flat)
            width = width_of(base + len(rules))
            begins = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])[:-1]])
            return pd.DataFrame([{
                "part": part, "shard": shard, "start": start, "n_tokens": len(flat), "doc_ids": owners, "doc_starts": begins, "base": base,
                "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "width": width, "symbols": packed(symbols, width),
            }])

        for frame in _heaps(batches):
            for own, doc_id, own_ids in zip(frame["part"].tolist(), frame["doc_id"].tolist(), known.packed_each(frame["text"].tolist()), strict=True):
                if ids and (own != part or size >= shard_tokens):
                    yield close()
                    shard, start, size, ids, owners = shard + 1, start + size, 0, [], []
                if own != part:
                    part, shard, start = own, 0, 0
                ids.append(own_ids)
                owners.append(doc_id)
                size += len(own_ids) // 4
        if ids:
            yield close()

    arrow_rows(spark)
    dealt = rows.withColumn("part", range_part(F.col("doc_id"), bounds))
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    dealt.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, _SHARD).write.parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start`` counted over all parts; the only global sort is of one row a part. The sums are
    sent to the shards if they are few enough, else joined."""
    rows = spark.read.schema(_SHARD).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.select("part", before.alias("_before")), "parts")
    sent = F.broadcast(parts) if parts.count() <= SENT_PARTS else parts
    return rows.join(sent, "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, part, shard and, if asked for, the
    ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                known = Shard(row.base, row.rules, row.lengths, row.width, row.symbols)
                flat = known.all().astype("<u4")
                cuts = [*np.asarray(row.doc_starts).tolist(), row.n_tokens]
                pieces = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                out = {
                    "doc_id": list(row.doc_ids), "start": np.array(cuts[:-1]) + row.start, "n_tokens": np.diff(cuts),
                    "ids_crc32": [zlib.crc32(x) for x in pieces], "part": row.part, "shard": row.shard,
                }
                yield pd.DataFrame(out | ({"ids": pieces} if with_ids else {}))

    arrow_rows(spark)
    return ids_as_long(shards(spark, path).mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long, part int, shard int" + ", ids binary" * with_ids))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to the shared folder and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
