"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples; documents without any label are the unlabelled
ones, toxic or not. With the share of toxic documents (the class prior) as ``prior``, the risk of a
scorer f under a loss is estimated as

    prior * mean over positives of loss(f)
      + max(0, mean over unlabelled of loss(-f) - prior * mean over positives of loss(-f)),

the second term being the risk on clean documents, which an over-fitted scorer would drive below
zero; where it is below zero its gradient is turned round. The scorer is linear in hashed features: the
words of the whole text and their first letters, each distinct word counting once. Weights are kept
sparse: only features that positives have more often are fitted, and soft thresholds clear weak ones. It is fitted with numpy on bounded samples,
the documents of either kind with the smallest hashes of id and text; how many of them have a feature is counted in tasks, so that only
features worth fitting reach the driver. Labels of clean documents serve for the prior only: it is the share of toxic ones among
all labels, half a document added to either side, unless the caller knows better.

Defined results: a null or empty text gets the score of a text without known words; repeated rows are scored
alike; an empty table gives no rows; a null doc_id is kept, counts as not held out, and has no label; labels
without a document are ignored; of contradicting labels of a document the toxic one counts; without a
positive example, or without labels of both kinds, the prior is ``PRIOR_UNKNOWN``, and without a positive example every score is the prior's;
a text of any length is scored whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_sample, held_out, ids_as_long, ids_as_text, materialise

#: Places of hashed features; most documents of either kind that a scorer is fitted on.
PLACES, POSITIVES, UNLABELLED = 1 << 18, 4_000, 8_000
#: A feature is fitted if so many positives have it, so many times more often than unlabelled texts.
SEEN, MORE = 4, 2.0
#: Letters of the beginnings of words that are features besides the words.
HEADS = (4, 5, 6)
#: The class prior where the labels do not tell it.
PRIOR_UNKNOWN = 0.1
#: Words whose weights a worker remembers before it starts afresh.
MEMO_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def places(word: str) -> list[int]:
    """The features of one word."""
    raw = [word, *(f"{word[:n]}*" for n in HEADS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % PLACES for x in raw]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}

    def __call__(self, text: str | None) -> float:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, total = self.memo, self.bias
        for word in words(text):
            known = memo.get(word)
            if known is None:
                known = memo[word] = float(self.weights[places(word)].sum())
            total += known
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, total)))))


def _sums(features: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    flat = np.concatenate(features)
    ends = np.cumsum([len(f) for f in features])
    sums = np.concatenate([[0.0], np.cumsum(w[flat], dtype="float64")])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def _telling(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int) -> np.ndarray:
    """Features in at least ``SEEN`` positives, and that much more often there than in unlabelled texts. ``p`` and ``u``: how
    many texts of either kind have each feature."""
    return (p >= SEEN) & (p / max(1, positives) >= MORE * u / max(1, unlabelled) + 1 / max(1, unlabelled))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, rate: float = 0.05, sparse: float = 0.018, seed: int = 11) -> Scorer:
    """nnPU with the logistic loss, by minibatches and Adam. The arguments are the telling features of documents (with
    repeats, as several words of a document may share a beginning; a document may have none)."""
    start = float(np.log(prior / (1 - prior)))
    w, b = np.zeros(PLACES, "float32"), start
    if not positive or not unlabelled:
        return Scorer(w, start)
    rng = np.random.default_rng(seed)
    m, v, mb, vb, step = np.zeros(PLACES, "float32"), np.zeros(PLACES, "float32"), 0.0, 0.0, 0
    batches = max(4, max(len(positive), len(unlabelled)) // 256)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 0.1 * rate
        for p_rows, u_rows in zip(np.array_split(rng.permutation(max(len(positive), batches)) % len(positive), batches), np.array_split(rng.permutation(max(len(unlabelled), batches)) % len(unlabelled), batches), strict=True):
            p, u = [positive[i] for i in p_rows], [unlabelled[i] for i in u_rows]
            fp, fu = _sums(p, w) + b, _sums(u, w) + b
            clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if clean >= 0:
                gp, gu = prior * (-sigmoid(-fp) - sigmoid(fp)) / len(p), sigmoid(fu) / len(u)
            else:
                gp, gu = prior * sigmoid(fp) / len(p), -sigmoid(fu) / len(u)
            flat = np.concatenate([*p, *u])
            each = np.repeat(np.concatenate([gp, gu]), [len(x) for x in (*p, *u)])
            g = np.bincount(flat, each, PLACES).astype("float32")
            gb, step = float(gp.sum() + gu.sum()), step + 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.001 * (gb * gb - vb)
            fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
            size = pace / (np.sqrt(v / fix2) + 1e-4)
            w -= size * m / fix
            w = np.sign(w) * np.maximum(np.abs(w) - size * sparse * prior, 0)
            b -= pace * (mb / fix) / (np.sqrt(vb / fix2) + 1e-4)
    return Scorer(w.astype("float32"), b - _cut(_sums(positive, w) + b, _sums(unlabelled, w) + b, prior))


def _cut(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The threshold with the least non-negative estimate of the share of wrong decisions: missed
    positives, and unlabelled texts above it beyond what the prior explains. Of equal ones the middle."""
    at = np.unique(np.concatenate([fp, fu]))
    edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    above = lambda f: 1 - np.searchsorted(np.sort(f), edges) / len(f)
    risk = prior * (1 - above(fp)) + np.maximum(0, above(fu) - prior * above(fp))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    run = best[: np.argmax(np.append(np.diff(best) > 1, True)) + 1]
    return float((edges[run[0]] + edges[run[-1]]) / 2)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Scorer:
    """docs (doc_id, text) and labels (doc_id, toxic), both without what is held out."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    n = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, others = n.get(True, 0), n.get(False, 0)
    if prior is None:
        prior = (found + 0.5) / (found + others + 1) if found and others else PRIOR_UNKNOWN
    # ids and draws meet the labels; only the sampled rows' texts are fetched
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("toxic"), "doc_id", "text").alias("_draw"))
    drawn = drawn.join(marks, F.col("doc_id") == F.col("_id"), "left").where("_toxic IS NULL OR _toxic")
    drawn = materialise(drawn.select("doc_id", "_draw", F.coalesce("_toxic", F.lit(False)).alias("toxic")), "draws")
    picked = bounded_sample(drawn.where("toxic"), positives, "toxic", "_draw").union(bounded_sample(drawn.where("NOT toxic"), unlabelled, "toxic", "_draw"))
    picked = picked.groupBy(F.col("doc_id").alias("_id"), F.col("_draw").alias("_d"), "toxic").agg(F.count(F.lit(1)).alias("_copies"))
    draw = F.xxhash64(F.lit("toxic"), "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_draw", draw)
    rows = rows.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_draw") == F.col("_d")))
    rows = rows.groupBy("_draw", "_id", "toxic").agg(F.first("text").alias("text"), F.first("_copies").alias("_copies"))  # copies are counted before they move
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("text", "toxic")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(sorted(x for word in words(t) for x in places(word)), "<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "features": found})

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, texts = np.zeros((2, PLACES), "int64"), np.zeros(2, "int64")
        for batch in batches:
            for toxic, f in zip(batch["toxic"].tolist(), batch["features"], strict=True):
                have[toxic, np.unique(np.frombuffer(f, "<i4"))] += 1
                texts[toxic] += len(f) > 0
        for toxic in (0, 1):
            at = np.flatnonzero(have[toxic])
            yield pd.DataFrame({"toxic": toxic, "place": np.append(at, -1), "n": np.append(have[toxic, at], texts[toxic])})

    arrow_rows(spark)
    sample = materialise(rows.mapInPandas(features, "toxic int, features binary"), "features")
    sums = sample.mapInPandas(tally, "toxic int, place int, n long").groupBy("toxic", "place").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros((2, PLACES + 1), "int64")  # the last place holds the number of texts
    have[sums["toxic"], sums["place"]] = sums["n"]
    telling = _telling(have[1, :PLACES], have[0, :PLACES], have[1, -1], have[0, -1])
    sent = spark.sparkContext.broadcast(telling)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["features"].map(len) > 0]
            own = [np.frombuffer(f, "<i4") for f in batch["features"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "features": [f[sent.value[f]].tobytes() for f in own]})

    known = sample.mapInPandas(told, "toxic int, features binary").toPandas().sort_values(["toxic", "features"])
    known = [(t, np.frombuffer(f, "<i4")) for t, f in zip(known["toxic"], known["features"], strict=True)]
    return fit([f for t, f in known if t == 1], [f for t, f in known if t != 1], prior)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))  # bounded by the places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Scorer(*sent.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [known(t) for t in batch["text"]]})

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text").mapInPandas(run, "doc_id string, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(doc_id) modulo ``folds`` is ``fold`` are held
    out: neither their labels nor their texts are learned from."""
    out = held_out(F.col("doc_id"), folds, fold)
    scorer = learn(docs.where(~out), labels.where(~out), prior=prior)
    return score(docs, scorer).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
