"""SimHash near-duplicates: links within a Hamming radius, found with BK-trees.

A document's fingerprint is the majority bit, at each of 64 places, of the XXH64 hashes of its word
shingles. Equal fingerprints are one class; only classes are compared. Two fingerprints that differ
in at most ``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so each (block,
value) is a shard with its own BK-tree, and every link is found in some shard. Many fingerprints are cut into more
blocks, of which two or more agree, so that shards stay small at any size; and the members of shards that are
large all the same are cut into more blocks once again, by themselves: a pair of a large shard has both its
members among them. Where the most blocks leave a large shard it is dealt to parts, and each two parts meet in a task. A tree's children are
keyed by their integer distance to the parent, and a search follows only the edges from d - radius to
d + radius, where d is its distance to the node. A tree lives in the task that holds its shard (trees
of all shards of a batch are searched together), so none is sent anywhere.

A shard reports the components of its links, as links to the first member, never all pairs: a search
leaves out subtrees whose members are all in its own component already, so a dense group of near
copies costs about as much as its size.

Defined results: a null or empty text has no shingle and fingerprint zero, and links like any other;
fewer words than a shingle make one shingle of all; repeated shingles count each time; a text of any length is
hashed whole; repeated rows share their class; an empty table gives no rows; other columns are ignored. A null doc_id is kept and
never names a class unless all of the class are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, ids_as_long, ids_as_text, materialise, whole_groups
from .components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Pairs of a search and a node that are handled at once; some 200 MB.
FRONTIER = 2_000_000
#: Fingerprints that a shard should have at most, were they evenly spread, and that a tree holds at most.
SHARD, TREE = 2048, 1 << 16
#: Blocks that agree at most: a fingerprint has then 210 shards.
MOST_AGREE = 6
#: Fingerprints whose trees are searched together.
TOGETHER = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of one text, repeats included."""
    from xxhash import xxh64_intdigest

    body = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACE)
    parts = [w for w in body.split(b" ") if w]
    if not parts:
        return np.empty(0, "<u8")
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1) - 1
    first, last = np.concatenate([[0], ends[:-1] + 1]), ends
    if len(parts) > words:
        first, last = first[: len(parts) - words + 1], last[words - 1 :]
    else:
        first, last = first[:1], last[-1:]
    return np.fromiter((xxh64_intdigest(line[i:j], seed) for i, j in zip(first.tolist(), last.tolist(), strict=True)), "<u8", len(first))


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of hashes, as a signed 64-bit integer; zero of none."""
    total = np.zeros(64, "int64")
    for at in range(0, len(hashes), 1 << 16):  # very long texts in parts
        total += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 majority bits of one text, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t, words, seed) for t in batch["text"]], "int64")})

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text").mapInPandas(run, "doc_id string, fp long"))


class Forest:
    """BK-trees of several groups, grown together: the first of each group is its root, and in each
    step every waiting member either becomes the child of its node at its distance or moves on to
    the child that is already there."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values = values
        _, first, member = np.unique(group, return_index=True, return_inverse=True)
        self.root = first[member]
        self.parent = np.full(n, -1)
        self.distance = np.zeros(n, "int64")
        self.levels: list[np.ndarray] = []
        at = self.root.copy()
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        while len(waiting):
            d = np.bitwise_count(values[waiting] ^ values[at[waiting]]).astype("int64")
            _, lead, child = np.unique(at[waiting] * 65 + d, return_index=True, return_inverse=True)
            new = waiting[lead]
            self.parent[new], self.distance[new] = at[new], d[lead]
            self.levels.append(new)
            at[waiting] = new[child]
            keep = np.ones(len(waiting), bool)
            keep[lead] = False
            waiting = waiting[keep]
        grown = np.concatenate(self.levels) if self.levels else np.empty(0, "int64")
        key = self.parent[grown] * 65 + self.distance[grown]
        order = np.argsort(key, kind="stable")
        self.child_key, self.child = key[order], grown[order]

    def spread(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest label in each node's subtree."""
        low, high = labels.copy(), labels.copy()
        for level in reversed(self.levels):
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return low, high

    def within(self, search: np.ndarray, radius: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (search, node) within the radius, but for some that lie inside one label."""
        low, high = self.spread(labels)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(search, self.root[search])]
        while todo:
            who, node = todo.pop()
            open_ = ~((low[node] == high[node]) & (low[node] == labels[who]))
            who, node = who[open_], node[open_]
            if len(who) > FRONTIER:
                half = len(who) // 2
                todo += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            if not len(who):
                continue
            d = np.bitwise_count(self.values[who] ^ self.values[node]).astype("int64")
            near = (d <= radius) & (who != node)
            found.append((who[near], node[near]))
            lo = np.searchsorted(self.child_key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.child_key, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            shift = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            todo.append((np.repeat(who, many), self.child[np.arange(many.sum()) + shift]))
        if not found:
            return np.empty(0, "int64"), np.empty(0, "int64")
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of a root) after the links a-b."""
    labels = labels.copy()
    while len(a):
        ra, rb = labels[a], labels[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up
    return labels


def group_components(group: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each value the index of the first member of its component among the values of its group
    that link within the radius."""
    n = len(values)
    labels = np.arange(n)
    if n < 2:
        return labels
    forest, at, step = Forest(group, values), 0, 256
    while at < n:
        a, b = forest.within(np.arange(at, min(n, at + step)), radius, labels)
        labels = joined(labels, a, b)
        at, step = at + step, min(step * 4, 1 << 16)
    return labels


def _shards(fp: Column, radius: int, agree: int) -> Column:
    """The shards of a fingerprint, each as one long: the values of every choice of ``agree`` of ``radius + agree``
    blocks of bits. Fingerprints within the radius agree in at least one choice."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    choices = list(combinations(range(n), agree))
    keys = []
    for i, choice in enumerate(choices):
        value = F.lit(0).cast("long")
        for block in choice:
            width = edges[block + 1] - edges[block]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, edges[block]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(value * len(choices) + i)
    return F.array(*keys)


def blocks_to_agree(n: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """So many blocks that ``n`` evenly spread fingerprints make shards of at most ``shard``; more blocks mean more shards
    for each fingerprint, and as complete a search."""
    agree = 1
    while agree < MOST_AGREE and n >> (64 * agree // (radius + agree)) > shard:
        agree += 1
    return agree


def _searched(sharded: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the shards (shard, i, j) of fingerprints (fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["shard", "i", "j"], TOGETHER):
            fp = rows["fp"].to_numpy()
            label = group_components(rows.groupby(["shard", "i", "j"], sort=False).ngroup().to_numpy(), fp.view("uint64"), radius)
            other = label != np.arange(len(fp))
            yield pd.DataFrame({"a": fp[label[other]], "b": fp[other]})

    arrow_rows(sharded.sparkSession)
    return sharded.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, agree: int | None = None, tree: int = TREE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within the
    radius. ``fps`` is read more than once, so best a table."""
    agree = agree or blocks_to_agree(fps.count(), radius)
    found: list[DataFrame] = []
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    while True:
        sharded = fps.select("fp", F.explode(_shards(F.col("fp"), radius, agree)).alias("shard"))
        large = materialise(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tree), "large")
        if large.isEmpty():
            found.append(_searched(sharded.select("fp", "shard", *whole), radius))
            break
        found.append(_searched(sharded.join(large, "shard", "left_anti").select("fp", "shard", *whole), radius))
        if agree >= MOST_AGREE:
            parts = F.ceil(F.col("_n") / tree).cast("int")
            dealt = sharded.join(large, "shard").withColumn("_q", F.explode(F.sequence(F.lit(0), parts))).withColumn("_p", F.pmod(F.xxhash64("fp"), parts + 1).cast("int"))
            found.append(_searched(dealt.select("fp", "shard", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j")), radius))
            break
        fps = materialise(sharded.join(large, "shard", "left_semi").select("fp").distinct(), "crowded")
        agree += 1
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id that links reach, the row's own included)."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(classes.select("fp"), radius))
    named = classes.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
