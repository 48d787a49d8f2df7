"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, infill, langid, media, mixing, packing, pii, repair, simhash, topk, toxicity, warc, winnowing
from .common import read_table

BYTE_TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_found", "kinds")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = repair.tokenised(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compared(read_table(spark, sf_dir, "documents"))
    spelled = {c: winnowing.spelled(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")}
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *spelled.values(), "near_edited", "near_next")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.stored_features(read_table(spark, sf_dir, "documents"))
    return found.withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clusters(read_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_repair": op2_repair,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_winnowing": op5_winnowing,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_warc": op10_warc,
    "op11_topk": op11_topk,
    "op12_infill": op12_infill,
    "op13_centroids": op13_centroids,
}

_WHOLE = """list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"""
_FINITE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _topk_sql(every: int, k: int, scale: int) -> str:
    return f"""
WITH v AS (SELECT vec_id, {_WHOLE.format(scale=scale)} AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""


def _infill_sql(seed: int, rate: int, suffix_first: int) -> str:
    digit = lambda i: f"CAST('0x' || substr(code, {8 * i + 1}, 8) AS BIGINT)"
    has = " OR ".join(f"contains(t, '{x}')" for x in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    p, s, m = infill.PREFIX, infill.SUFFIX, infill.MIDDLE
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, {", ".join(f"{digit(i)} AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN t = '' OR {has} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{s}' || s || '{p}' || p || '{m}' || m ELSE '{p}' || p || '{s}' || s || '{m}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x"""


def _centroids_sql(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    floor_div = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, {_WHOLE.format(scale=scale)} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = {width})""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY code, v) - 1 AS INTEGER) AS cluster, v AS c
            FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS code FROM v) QUALIFY row_number() OVER (ORDER BY code, v) <= {k})""",
    ]
    for i in range(rounds + 1):
        near = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        steps.append(f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(distance := d, cluster := cluster)) AS best FROM (SELECT v.row, v.vec_id, v.v, c.cluster, {near} AS d FROM v, c{i} AS c) GROUP BY row)")
        if i < rounds:
            steps.append(f"e{i} AS (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i})")
            steps.append(f"m{i} AS (SELECT cluster, list({floor_div} ORDER BY j) AS c FROM (SELECT cluster, j, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM e{i} GROUP BY cluster, j) GROUP BY cluster)")
            steps.append(f"c{i + 1} AS (SELECT cluster, coalesce(m.c, c.c) AS c FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))")
    return f"""
WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT a.vec_id, a.best.cluster AS cluster, a.best.distance AS distance, CAST(sum(a.best.distance) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON c.cluster = a.best.cluster"""


#: The other operators learn, draw, hash or tokenise, which DuckDB's SQL has no equal for; tests/llm has plain versions.
ORACLES: dict[str, str] = {
    "op11_topk": _topk_sql(topk.EVERY, topk.K, topk.SCALE),
    "op12_infill": _infill_sql(infill.SEED, infill.RATE, infill.SUFFIX_FIRST),
    "op13_centroids": _centroids_sql(centroids.K, centroids.ROUNDS, centroids.WIDTH, centroids.SCALE, centroids.SEED),
}
