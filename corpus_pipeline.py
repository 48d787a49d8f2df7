"""Corpus pipeline: language ID, near-duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents, whatever other columns docs has. A document is a doc_id with a text: rows of one doc_id with
different texts are different documents, in every stage.

Defined results: language ID drops null and empty texts, and all without a letter, and keeps every other row, a null doc_id and repeated
rows included; of a group of near copies the document with the smallest doc_id stays, null last, then the smallest hash of
its text, as one row (of its repeated rows the smallest by text, source, lang, n_chars); pseudonyms keep all rows, null texts as they
are; mixing takes each row as often as its source's target asks, 0 to 3 times, equal rows sharing their copies, a null source being a
source; packing cuts documents of more than 2,048 tokens and packs null and empty texts as one token. Texts of any length are
handled whole. An empty table gives no rows at every stage.

The key of the pseudonyms is the setting ``spark.millrace.pseudonyms.key``; where it is unset a key that everybody knows serves,
which is for tests only, and a warning says so.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, pii, similar
from millrace.llm.common import DOCUMENT_COLUMNS, held_out, materialise, read_table

KEY_SETTING = "spark.millrace.pseudonyms.key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, in which no language can be told, go."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return langid.predict(docs, model, keep=DOCUMENT_COLUMNS).where(F.col("lang_pred") != langid.UNKNOWN).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 or more join, one stays, as one row."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = similar.near_copies(docs)
    stay = found.where("first").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("_n"))
    stay = materialise(stay.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "_n"), "stay")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (similar.tag_of(F.col("text")) == F.col("_tag"))
    once = docs.join(stay.where("_n = 1").hint("merge"), same, "left_semi")
    repeated = stay.where("_n > 1")
    if repeated.isEmpty():
        return once
    # repeated rows meet as an aggregate, so they are reduced before they move
    rows = docs.join(repeated, same, "left_semi").groupBy("doc_id", similar.tag_of(F.col("text")).alias("_tag"))
    return once.union(rows.agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r")).select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms under the caller's key; n_chars follows where a text's length changes."""
    given = spark.conf.get(KEY_SETTING, None)
    if given is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the known key can be undone by anyone", stacklevel=2)
    done = pii.pseudonyms(docs, given.encode() if given is not None else pii.KEY, keep=DOCUMENT_COLUMNS)
    return done.withColumn("n_chars", F.when(F.col("n_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("_tag", similar.tag_of(F.col("text")))
    keys = ("_tag", "lang", "n_chars")
    chosen = mixing.mix(docs, keys=keys).groupBy("doc_id", "source", *keys).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n"))
    chosen = materialise(chosen.where("_copies > 0").withColumnsRenamed({c: f"{c}_" for c in ("doc_id", "source", *keys)}), "copies")
    if not chosen.where("_n > 1").isEmpty():  # equal rows share their copies
        docs = docs.dropDuplicates()
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("doc_id", "source", *keys)]
    both = docs.join(chosen.hint("merge"), same)
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("PII", pseudonyms),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned models and fingerprints are not SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
