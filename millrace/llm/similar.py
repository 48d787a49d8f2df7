"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a bucket: a band of MinHash values, or a SimHash component found with BK-trees. At
similarity 0.8 SimHash fingerprints differ in about ten of 64 bits, more than any blocks of bits can
reach, so the bands carry the search: 24 bands of 5 values miss a pair at 0.8 with a chance of 7 in
100,000, and fewer above. Every candidate is confirmed by the exact similarity, so nothing else links.

Documents with equal sets are one class. Each class of a bucket is first compared with the bucket's
first, so that a dense group of copies costs about as much as its size. Buckets whose classes are not all
joined then are taken apart in tasks that hold the sets of shingles: a pair is looked at in its first common
bucket only, if its sizes and its MinHash values allow the similarity and nothing has joined it yet, and only
links leave the task. A large bucket is cut into parts of about ``PART_BYTES`` and each two parts meet in a
task of their own, so no task holds more than two parts. Many unlike documents in one bucket cost their
pairs' comparison, never their output.

Defined results: a text without words has the empty set, and links only with others of that kind;
fewer words than a shingle make one shingle of all; a text of any length is compared whole; repeated rows are in one
component; rows of one doc_id, or without one, are told apart by their texts; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, ids_as_long, ids_as_text, materialise, whole_groups
from .components import components
from .simhash import SEED, links, majority, shingle_hashes

WORDS, BANDS, VALUES = 5, 24, 5
#: Shingles whose MinHash values are computed at once.
CHUNK = 1 << 14
#: Bytes of shingle sets in one part of a bucket, about.
PART_BYTES = 16 << 20
#: MinHash values of two documents that must be equal at least: at similarity 0.8 fewer have a chance of 2 in 100,000,000.
ALIKE = BANDS * VALUES * 6 // 10
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * VALUES, "uint64") * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * VALUES, "uint64")


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingle hashes."""
    least = np.full(BANDS * VALUES, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK] * _TIMES[:, None] + _PLUS[:, None]).min(1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of MinHash values."""
    from xxhash import xxh64_digest

    keys = b"".join(xxh64_digest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, VALUES)))
    return np.frombuffer(keys, ">i8").tolist()


def short_values(least: np.ndarray) -> bytes:
    """A byte of each MinHash value."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype("u1").tobytes()


def _class_of(hashes: np.ndarray) -> int:
    """The class of a sorted set of shingle hashes."""
    from xxhash import xxh64_digest

    return int(np.frombuffer(xxh64_digest(hashes.tobytes(), SEED), ">i8")[0])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tag, class (of equal sets), n (shingles of the set), fp (SimHash), bands, least (a byte of each MinHash value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, tag, text in zip(batch["doc_id"], batch["tag"], batch["text"], strict=True):
                every = shingle_hashes(text, WORDS)
                own = np.unique(every)
                least = least_values(own)
                out.append((doc_id, tag, _class_of(own), len(own), majority(every), bands(least), short_values(least)))
            yield pd.DataFrame(out, columns=["doc_id", "tag", "class", "n", "fp", "bands", "least"])

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "tag", "text").mapInPandas(run, "doc_id string, tag string, class long, n long, fp long, bands array<long>, least binary"))


def _sets(docs: DataFrame) -> DataFrame:
    """class, hashes (signed, distinct) of every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique(shingle_hashes(text, WORDS)) for text in batch["text"]]
            yield pd.DataFrame({"class": np.array([_class_of(h) for h in own], "int64"), "hashes": [h.view("i8") for h in own]})

    arrow_rows(docs.sparkSession)
    return docs.select("text").mapInPandas(run, "class long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose similarity is 0.8 or more."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("hashes").alias(f"h{c}"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both * 9 >= (F.size("ha") + F.size("hb")) * 4).select("a", "b")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def cell_links(bucket: int, part: np.ndarray, label: np.ndarray, keys: np.ndarray, least: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (indices) of a bucket's members that join different labels; of two parts, those between the parts.
    A pair with a common key before this bucket's is left to that key's bucket."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, part, label, keys, least = size[order], part[order], label[order].copy(), keys[order], least[order]
    turn = int(np.flatnonzero(keys[0] == bucket)[0])
    across, out = len(np.unique(part)) > 1, []
    for i in range(len(size) - 1):
        end = int(np.searchsorted(size, size[i] * 5 // 4, "right"))
        with_ = np.arange(i + 1, max(i + 1, end))
        with_ = with_[label[with_] != label[i]]
        if across:
            with_ = with_[part[with_] != part[i]]
        if turn:
            with_ = with_[~(keys[with_, :turn] == keys[i, :turn]).any(1)]
        with_ = with_[(least[with_] == least[i]).sum(1) >= ALIKE]
        for j in with_.tolist():
            if label[j] != label[i] and _similar(sets[order[i]], sets[order[j]]):
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _apart(parted: DataFrame, classes: DataFrame, sets: DataFrame, part_bytes: int) -> DataFrame:
    """Links (a, b) between classes of one bucket with different labels. parted: bucket, class, n, label."""
    spark = parted.sparkSession
    sizes = materialise(parted.groupBy("bucket").agg(F.ceil(F.sum("n") * 8 / part_bytes).cast("int").alias("_parts"), F.sum("n").alias("_n")), "sizes")
    work = sizes.agg(F.sum(F.col("_n") * F.col("_parts")).cast("double").alias("n")).first()["n"] or 0.0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(work * 8 / part_bytes) + 1)
    seated = parted.join(sizes.drop("_n"), "bucket").withColumn("part", F.pmod(F.xxhash64("class"), F.greatest("_parts", F.lit(1))).cast("int"))
    full = seated.join(classes.select("class", "bands", "least"), "class").join(sets, "class")
    met = full.withColumn("_q", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_parts") - 1, F.lit(0)))))
    met = met.select("bucket", F.least("part", "_q").alias("i"), F.greatest("part", "_q").alias("j"), "part", "class", "label", "bands", "least", "hashes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            least = np.frombuffer(b"".join(rows["least"]), "u1").reshape(len(rows), -1)
            sets = [np.sort(np.asarray(h, "int64")) for h in rows["hashes"]]
            found = cell_links(rows["bucket"].iloc[0], rows["part"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["bands"].to_list()), least, sets)
            own = rows["class"].to_numpy()
            return pd.DataFrame({"a": [own[a] for a, _ in found], "b": [own[b] for _, b in found]}, dtype="int64")

        for frame in whole_groups(batches, ["bucket", "i", "j"], 1):
            for _, rows in frame.groupby(["bucket", "i", "j"], sort=False):
                yield solve(rows)

    arrow_rows(spark)
    return met.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(run, "a long, b long")


def tag_of(text: Column) -> Column:
    """Tells texts of one doc_id apart, and a null one from an empty one."""
    return F.coalesce(F.md5(text), F.lit(""))


def near_copies(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, tag (of its text), component_id (the smallest doc_id that links reach, the
    row's own included; null if all are) and first: whether the row's id and text are those that come first in the
    component, by doc_id (null last), then tag."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(F.col("text")).alias("tag"), "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "tag")
    rows = materialise(sketches(docs), "sketches")
    classes = rows.groupBy("class").agg(F.min(key).alias("first_id"), *[F.first(c).alias(c) for c in ("n", "fp", "bands", "least")])
    classes = materialise(classes, "classes")
    found = components(links(materialise(classes.select("fp").distinct(), "fps"))).withColumnRenamed("vertex", "fp")
    rooted = classes.join(found, "fp", "left").withColumn("bands", F.concat("bands", F.array(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")))))
    rooted = materialise(rooted.select("class", "n", "first_id", "bands", "least"), "rooted")
    buckets = rooted.select("class", "n", "first_id", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
    shared = materialise(buckets.join(heads, "bucket"), "shared")

    wanted = shared.select("class", "first_id").distinct()
    named = wanted.select("first_id.*").distinct()
    held = F.col("doc_id").isNull().eqNullSafe(F.col("none")) & (F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("id")) & (docs["tag"] == named["tag"])
    sets = _sets(docs.join(named, held, "left_semi"))
    sets = materialise(sets.groupBy("class").agg(F.first("hashes").alias("hashes")).join(wanted, "class", "left_semi"), "sets")

    tried = shared.where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    edges = materialise(_confirmed(tried, sets), "links")
    labelled = shared.join(components(edges).withColumnRenamed("vertex", "class"), "class", "left").select("bucket", "class", "n", F.coalesce("root", "class").alias("label"))
    parted = labelled.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("_open")).where("_open").select("bucket")
    labelled = materialise(labelled.join(parted, "bucket", "left_semi"), "parted")
    found = components(edges.union(_apart(labelled, rooted, sets, part_bytes)))

    named = classes.join(found.withColumnRenamed("vertex", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "first_id")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("class", "least_id")
    found = rows.select("doc_id", "tag", "class").join(named, "class")
    own = F.when(~F.col("least_id.none"), F.col("least_id.id"))
    return found.select("doc_id", "tag", own.alias("component_id"), (key == F.col("least_id")).alias("first"))
