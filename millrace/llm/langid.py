"""Hierarchical language identification: the family first, then the language within it.

Both steps are linear support vector machines, one against one, over hashed character n-grams of the
whole text. They are fitted with numpy on a bounded sample: at most ``per_language`` labelled documents
of each language, those with the smallest hashes of id and text. A pair is fitted in a task of its own, on the sparse n-gram
counts of its documents; the weights, a column for each pair, are put together on the driver and sent to every task. With L
languages that are families of their own there are L * (L - 1) / 2 pairs of 64 kB each.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could
be learned; ties go to the language that is first in the alphabet; repeated rows are scored alike; an
empty table gives no rows; a null doc_id is kept, counts as not held out, is learned from, and is scored; a null lang is never learned;
a text of any length is scored whole; other columns are ignored. Every non-null lang of the training rows is a possible prediction.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_sample, held_out, ids_as_long, ids_as_text, materialise

UNKNOWN = "und"
#: Labelled documents of each language that a model is fitted on, at most.
PER_LANGUAGE = 400
#: Places of the hashed n-grams, and their lengths in bytes.
PLACES, LENGTHS = 1 << 14, (2, 3, 4)
#: Language families by ISO 639-1 code. A language not named here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
    "sinitic": "zh",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_ASCII = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: What the shares of n-grams are multiplied by.
SCALE = 16.0
#: Bytes of text that are turned into n-grams at once.
_CHUNK = 1 << 17


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def letters(text: str) -> np.ndarray:
    """The lower-cased text in UTF-8 with each run of other ASCII characters as one space, and a space at
    both ends."""
    body = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_ASCII), "u1")
    blank = body == 32
    return body[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def places(body: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length the place of the n-gram that starts at each byte."""
    b = body.astype("uint32")
    rolled, out = b, []
    for n in range(2, max(LENGTHS) + 1):
        if len(b) < n:
            break
        rolled = (rolled[: len(b) - n + 1] * np.uint32(0x01000193)) ^ b[n - 1 :]
        if n in LENGTHS:
            out.append((rolled * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(33 - PLACES.bit_length()))
    return out


def parts(body: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that overlap so that each n-gram of the longest kind is in one."""
    for at in range(0, len(body), _CHUNK):
        yield body[at : at + _CHUNK + max(LENGTHS) - 1]


def counts(text: str) -> np.ndarray:
    total = np.zeros(PLACES, "float32")
    for part in parts(letters(text)):
        for g in places(part):
            total += np.bincount(g, minlength=PLACES)
    return total


def svm(at: list[np.ndarray], n: list[np.ndarray], y: np.ndarray, epochs: int = 30, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, y being 1 or -1: averaged
    stochastic subgradients of the hinge loss, either class counting the same. A document is the places that it has
    and their counts, taken as shares at the scale ``SCALE``."""
    rng = np.random.default_rng(seed)
    at = [a.astype("int64") for a in at]
    n = [x * (SCALE / max(float(x.sum()), 1.0)) for x in n]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype("float32")
    w, total, steps, step = np.zeros(PLACES + 1, "float32"), np.zeros(PLACES + 1, "float64"), 0, 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            x = np.zeros((len(rows), PLACES), "float32")
            for k, i in enumerate(rows.tolist()):
                x[k, at[i]] = n[i]
            wrong = y[rows] * (x @ w[:-1] + w[-1]) < 1
            pull = weight[rows[wrong]] * y[rows[wrong]]
            w *= 1 - decay
            w[:-1] += 0.5 / len(rows) * (pull @ x[wrong])
            w[-1] += 0.05 / len(rows) * pull.sum()
            if epoch * 2 >= epochs:
                total += w
                steps += 1
    return (total / max(steps, 1)).astype("float32")


@dataclass
class Model:
    """A column of ``weights`` for each pair in ``pairs``: pairs of families first, then pairs of the
    languages of a family. A positive margin speaks for the first of the pair."""

    langs: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """A row for each text; short texts are looked up together."""
        out = np.zeros((len(texts), len(self.pairs)), "float64")
        bodies = [letters(t) for t in texts]
        at = 0
        while at < len(bodies):
            to, size = at + 1, len(bodies[at])
            while to < len(bodies) and size + len(bodies[to]) <= _CHUNK:
                size += len(bodies[to])
                to += 1
            if to == at + 1:
                found = [self._sums(p, np.array([0]), np.array([len(p)])) for p in parts(bodies[at])]
                sums, n = sum(s for s, _ in found), sum(n for _, n in found)
            else:
                ends = np.cumsum([len(b) for b in bodies[at:to]])
                sums, n = self._sums(np.concatenate(bodies[at:to]), np.concatenate([[0], ends[:-1]]), ends)
            out[at:to] = sums * (SCALE / np.maximum(n, 1))[:, None] + self.weights[-1]
            at = to
        return out

    def _sums(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights, and the number of n-grams, of each stretch of ``body``."""
        sums, n = np.zeros((len(starts), len(self.pairs))), np.zeros(len(starts), "int64")
        table = np.concatenate([self.weights[:-1], np.zeros((1, len(self.pairs)), "float32")])
        for length, g in zip(LENGTHS, places(body), strict=False):
            g = np.concatenate([g, np.full(length - 1, PLACES, g.dtype)])
            for back in range(1, length):  # n-grams that would reach into the next stretch
                g[np.maximum(ends - back, starts)] = PLACES
            for j in range(len(self.pairs)):
                sums[:, j] += np.add.reduceat(np.take(table[:, j], g), starts)
            n += np.maximum(ends - starts - length + 1, 0)
        return sums, n

    def _vote(self, group: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins, worst = dict.fromkeys(names, 0), dict.fromkeys(names, np.inf)
        for (of, a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            if of == group:
                wins[a if m >= 0 else b] += 1
                worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        best = max(names, key=lambda n: (wins[n], worst[n]))
        return best, float(1 / (1 + np.exp(-np.clip(2 * worst[best], -50, 50))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        for i, margins in zip(known, self.margins([texts[i] for i in known]), strict=True):
            family, sure = self._vote("", sorted(self.langs), margins)
            lang, surer = self._vote(family, self.langs[family], margins)
            out[i] = (lang, sure * surer)
        return out


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"own:{lang}")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang. Reads the table for the draws and the sampled texts."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = rows.withColumn("_draw", F.xxhash64(F.lit("langid"), "doc_id", "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].map(has_letter)]
            totals = [counts(t) for t in batch["text"]]
            at = [np.flatnonzero(t) for t in totals]
            yield pd.DataFrame({"lang": batch["lang"], "draw": batch["_draw"], "at": [a.astype("<u2").tobytes() for a in at], "n": [t[a].astype("<f4").tobytes() for t, a in zip(totals, at, strict=True)]})

    arrow_rows(spark)
    sample = bounded_sample(rows, per_language, "lang", "_draw").select("lang", "_draw", "text")
    sample = materialise(sample.mapInPandas(count, "lang string, draw long, at binary, n binary"), "sample")
    langs: dict[str, list[str]] = {}
    for (name,) in sample.select("lang").distinct().orderBy("lang").collect():
        langs.setdefault(family_of(name), []).append(name)
    pairs = [("", a, b) for a, b in itertools.combinations(sorted(langs), 2)]
    pairs += [(f, a, b) for f, names in sorted(langs.items()) for a, b in itertools.combinations(names, 2)]
    if not pairs:
        return Model(langs, [], np.zeros((PLACES + 1, 0), "float32"))
    members = lambda group, side: langs[side] if group == "" else [side]
    sides = [(i, name, y) for i, (group, a, b) in enumerate(pairs) for side, y in ((a, 1), (b, -1)) for name in members(group, side)]
    dealt = spark.createDataFrame(sides, "pair int, lang string, y int")

    def train(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values(["lang", "draw", "at", "n"])
        at, n = [np.frombuffer(a, "<u2") for a in pair["at"]], [np.frombuffer(x, "<f4") for x in pair["n"]]
        return pd.DataFrame({"pair": pair["pair"].iloc[:1], "w": [svm(at, n, pair["y"].to_numpy("float32")).astype("<f4").tobytes()]})

    fitted = sample.join(F.broadcast(dealt), "lang").repartition(len(pairs), "pair").groupBy("pair").applyInPandas(train, "pair int, w binary").collect()
    weights = {r["pair"]: np.frombuffer(bytes(r["w"]), "<f4") for r in fitted}
    return Model(langs, pairs, np.stack([weights[i] for i in range(len(pairs))], 1))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the places and the pairs of languages
    fields = [docs.schema[c] for c in keep if c not in ("doc_id", "text")]
    schema = ", ".join(["doc_id string", "text string" if "text" in keep else "", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string", "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            found = known.predict(batch["text"].tolist())
            out = batch if "text" in keep else batch.drop(columns="text")
            yield out.assign(lang_pred=[a for a, _ in found], score=[b for _, b in found])

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text", *[f.name for f in fields]).mapInPandas(run, schema.replace(", ,", ",")))


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows whose crc32(doc_id) modulo ``folds`` is ``fold`` are
    held out: nothing is learned from them."""
    model = fit(docs.where(~held_out(F.col("doc_id"), folds, fold)), per_language)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
