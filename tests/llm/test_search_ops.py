"""Exact search, infilling and centroid clustering against plain versions and their SQL."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("millrace.llm")
from pyspark.sql import functions as F

from millrace.llm import centroids, infill, queries, topk

from .test_text_ops import ODD, docs

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, row int, cluster int, n long"


def vectors(spark, rows):
    """Embeddings with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, v, 0, 0.5, 3, 4, 5, 6) for i, v in rows], VECTORS)


def odd_vectors(width, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.001, 1.0]) for _ in range(width)]) for i in range(n)]
    rows += [(0, rows[0][1]), (100, rows[1][1]), (100, rows[1][1]), (None, rows[2][1]), (None, [1.0] * width)]
    rows += [(200, None), (201, [None] + [1.0] * (width - 1)), (202, [math.nan] * width), (203, [math.inf] * width)]
    return rows


def floored(v, scale):
    return [math.floor(np.float64(np.float32(x)) * scale) for x in v]


def plain_topk(rows, every, k, scale):
    kept = [(i, floored(v, scale)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is None or q % every:
            continue
        score = lambda w, v=v: max(min(sum(a * b for a, b in zip(v, w, strict=False)), (1 << 63) - 1), -1 << 63)
        found = sorted((-score(w), c is None, c or 0) for j, (c, w) in enumerate(kept) if j != at)
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile_bytes", [topk.TILE_BYTES, 200])
def test_topk_equals_brute_force(spark, tile_bytes):
    rows = odd_vectors(5, 150) + [(300, [1.0, 2.0]), (301, []), (400, [])]
    got = topk.search(vectors(spark, rows), every=50, k=7, tile_bytes=tile_bytes, tile_rows=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_topk(rows, 50, 7, 1024)


def test_topk_of_large_numbers_few_rows_and_none(spark):
    rows = [(0, [1e7, -3.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [1e30, 0.0]), (5, [-1e7, 0.5])]
    got = topk.search(vectors(spark, rows), k=10)
    assert sorted(map(tuple, got.collect()), key=str) == plain_topk(rows, 100, 10, 1024)
    assert topk.search(vectors(spark, [])).count() == 0 and topk.search(vectors(spark, [(100, [1.0])])).count() == 0


def test_topk_strips():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (700, 6)).astype(float), rng.integers(-3, 4, (9000, 6)).astype(float)
    found, at = topk.tile(a, b, 11)
    s = a @ b.T
    order = np.lexsort((np.broadcast_to(np.arange(9000), s.shape), -s))[:, :11]
    assert (at == order).all() and (found == np.take_along_axis(s, order, 1)).all()


def test_topk_does_not_join_all_with_all(spark):
    plan = topk.search(vectors(spark, odd_vectors(4, 20)))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("offsets", [[], [0], range(0, 300_000, 40), range(5000), [*range(9000), 70_000, *range(131_070, 131_075)], sorted(random.Random(5).sample(range(200_000), 60_000))])
def test_boundary_set_selects(offsets):
    offsets = np.array(list(offsets), "int64")
    s = infill.BoundarySet(offsets)
    assert len(s) == len(offsets) and [s.select(i) for i in range(len(s))] == offsets.tolist()
    with pytest.raises(IndexError):
        s.select(len(s))


def test_all_kinds_of_containers_occur():
    kinds = {infill.Container(np.array(x)).kind for x in ([1, 9, 70], range(500), sorted(random.Random(1).sample(range(65_536), 30_000)))}
    assert kinds == {"array", "run", "bitmap"}


def plain_infill(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    code = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [*ODD, "\n", "\n\n", "a\nb", "a\n", "<\n<S\n<P\n<M", "x <P> y\nz", "é\r\nß\x0b 日本\n" * 3, "line\n" * 20_000, "\n" * 70_000, "same", "same"]


@pytest.mark.parametrize("rate", [100, 60])
def test_infill_equals_plain_version(spark, rate):
    rows = docs(spark, TEXTS * 3).union(docs(spark, ["no id\nhere"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = infill.fill_in_middle(rows, rate=rate).collect()
    texts = dict(enumerate(TEXTS * 3)) | {None: "no id\nhere"}
    assert len(got) == len(texts) and infill.fill_in_middle(docs(spark, [])).count() == 0
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, texts[r.doc_id], rate)
        assert r.restored == (texts[r.doc_id] or "")


def test_infill_restores_from_the_output_alone():
    for text in ("<\n<S\n<P\n<M\n<", "a\n\nb", "<\n" * 9):
        for i in range(50):
            _, form, _, _, output = infill.infilled(text, str(i))
            assert infill.restored(output, form) == text
    with pytest.raises(ValueError):
        infill.restored("<P>a", "psm")


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, floored(v, scale)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cent = [v for _, v in sorted(kept, key=lambda x: (code(x[0]), x[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        own = [[] for _ in cent]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cent = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(own, cent, strict=True)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, c, d in last if c == j) for j in range(len(cent))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    top = (1 << 63) - 1
    return sorted(((i, c, min(d, top), min(sums[c], top), min(sum(sums), top), name[c]) for i, c, d in last), key=str)


@pytest.mark.parametrize(("width", "block", "shard"), [(6, 2, 1000), (5, 2, 7), (4, 1, 30), (3, 8, 1000)])
def test_clusters_equal_brute_force(spark, width, block, shard):
    rows = [*odd_vectors(width, 120), (500, [1.0] * (width + 1)), (501, [])]
    found = centroids.clusters(vectors(spark, rows), k=9, rounds=3, width=width, block=block, shard=shard)
    got = centroids.with_inertia(*found)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 9, 3, width, 256)


def test_clusters_of_large_numbers_few_rows_and_none(spark):
    rows = [(1, [1e6, 2.0]), (2, [-1e6, 0.1]), (3, [1e6, 2.5]), (4, [3e6, -1e6])]
    for few in (rows, rows[:1], [(1, [0.0, 0.0])] * 5):
        got = centroids.with_inertia(*centroids.clusters(vectors(spark, few), k=3, width=2))
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(few, 3, 5, 2, 256)
    assert centroids.with_inertia(*centroids.clusters(vectors(spark, []), width=2)).count() == 0


def test_codes_are_lossless():
    rng = np.random.default_rng(4)
    v = rng.integers(-5, 5, (500, 7))
    codes, entries, before = centroids.encode(v, 3)
    back = np.concatenate([entries[before[b] + codes[:, b]] for b in range(codes.shape[1])], axis=1)[:, :7]
    assert (back == v).all() and all(len(np.unique(entries[i:j], axis=0)) == j - i for i, j in zip(before, before[1:], strict=False))
    c = rng.integers(-5, 5, (6, 7))
    assert (centroids.distances(codes, entries, before, c) == ((v[:, None] - c[None]) ** 2).sum(2)).all()


@pytest.mark.parametrize("name", ["op11_topk", "op12_infill", "op13_centroids"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
