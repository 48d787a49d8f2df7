"""Mixing, fingerprints of edits, media, archives and the pipeline against plain versions."""

import gzip
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("millrace.llm")
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from millrace.llm import media, mixing, pii, warc, winnowing

from .test_text_ops import ODD, docs


def water(sizes, weights, most):
    """Targets by raising a level step by step."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        level = left / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def test_targets(spark):
    for sizes in ([100, 1, 1, 50], [5], [0, 3, 9], [10, 10, 10, 10, 10, 10], [0, 0]):
        rows = spark.createDataFrame([(None if i == len(sizes) - 1 else f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        want = water(sizes, [1.0 + i % 3 for i in range(len(sizes))], 3.0) if sum(sizes) else [0] * len(sizes)
        assert np.allclose([got[None if i == len(sizes) - 1 else f"s{i}"] for i in range(len(sizes))], want)


def test_mixing(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", None, 0), (5000, "", "en", "src1", 0), (5000, "", "en", "src1", 0), (None, "x y", "en", "tiny", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    both = d.union(extra)
    got, again = (mixing.mix(x, leaf=16).collect() for x in (both, both.repartition(7)))
    key = lambda r: (str(r.source), r.doc_id or -1, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == both.count()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect()}
    per = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and r.size == words.get(r.doc_id, 2 if r.source == "tiny" else 0)
        s = per.setdefault(r.source, [0, 0, r.target, r.source_size, 0, 0])
        s[0], s[1], s[4], s[5] = s[0] + r.taken, s[1] + r.size, max(s[4], r.size), s[5] + r.copies
    names = sorted((s for s in per if s), key=str) + [None]
    assert np.allclose([per[s][2] for s in names], water([per[s][1] for s in names], [1.0 + i % 3 for i in range(len(names))], 3.0))
    for taken, size, target, stated, largest, _ in per.values():
        assert size == stated and abs(taken - target) <= 2 * largest
    assert mixing.mix(docs(spark, [])).count() == 0 and "Python" not in mixing.mix(both)._jdf.queryExecution().executedPlan().toString()


def test_pivotal_counts_are_right_but_for_one(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 5).alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    got = mixing.mix(d, leaf=8).groupBy("source", "target").agg(F.sum("copies").alias("n"), F.max("size").alias("size")).collect()
    assert all(abs(r.n - r.target / r.size) < 1.0001 for r in got)


def test_many_equal_rows_are_mixed(spark):
    d = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("source"))
    found = mixing.mix(d)
    got = found.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"hot": 15_000, "cold": 5_000} and all(abs(r.taken - r.target) <= 3.001 for r in got)
    rows = mixing._numbered(d.select("source"))
    assert rows.count() == 20_000 and rows.distinct().count() == 20_000 and rows.agg(F.max("_nth")).first()[0] == 14_999


def plain_winnow(text, gram=5, window=16):
    han = r"一-鿿぀-ヿ฀-๿"
    words = re.findall(rf"[{han}]|[^\x20\x09-\x0D{han}]+", text or "")
    h = [xxh64_intdigest(w.encode(), 42) for w in words]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    as_long = lambda x: signed(x).to_bytes(8, "little", signed=True)
    two = lambda a, b: xxh64_intdigest(as_long(b), xxh64_intdigest(as_long(a), 42))
    if len(words) < gram:
        return None
    g4 = [two(two(h[i], h[i + 1]), two(h[i + 2], h[i + 3])) for i in range(len(h) - 3)]
    g = [two(g4[i], h[i + 4]) >> 29 for i in range(len(h) - 4)]
    out = []
    for i in range(max(1, len(g) - window + 1)):
        part = g[i : i + window]
        at = max(j for j, x in enumerate(part) if x == min(part)) + i
        if (g[at], at) not in out:
            out.append((g[at], at))
    return out


def test_winnowing_equals_brute_force(spark):
    texts = [*ODD[:-1], "repeat " * 60, "日本語" * 9, *(" ".join(f"w{i * k % 23}" for i in range(k)) for k in range(1, 70, 3))]
    got = winnowing.fingerprints(docs(spark, texts)).select("doc_id", winnowing.hashes(F.col("fingerprint")).alias("h"), winnowing.positions(F.col("fingerprint")).alias("p"), F.transform("fingerprint", lambda x: F.shiftright(x, 28)).alias("all")).collect()
    for r in got:
        want = plain_winnow(texts[r.doc_id])
        if want is None:
            assert len(r.p) == (1 if re.search(r"[^\x20\x09-\x0D]", texts[r.doc_id] or "") else 0)
        else:
            assert list(zip(r["all"], r.p, strict=True)) == want, texts[r.doc_id]


def test_shared_passages_share_a_hash(spark):
    passage = " ".join(f"p{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    a, b = (f"{' '.join(f'{x}{i}' for i in range(40))} {passage} {' '.join(f'{x}{i}' for i in range(40, 77))}" for x in "uv")
    h = [set(r.h) for r in winnowing.fingerprints(docs(spark, [a, b])).select(winnowing.hashes(F.col("fingerprint")).alias("h")).collect()]
    assert h[0] & h[1]


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_edits(spark, n):
    texts = (ODD[:-1] * 4 + ["same text of some words here"] * 2)[:n]
    ids = [3 * i - 5 for i in range(n)]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.compared(rows).collect()}
    assert len(got) == n
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0

    def prints(text):  # hashes of whole short texts are the operator's own, others the plain version's
        want = plain_winnow(text)
        if want is None:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            return {("short", *words)} if words else set()
        return {x for x, _ in want}

    order = sorted(ids, reverse=True)
    by = dict(zip(ids, texts, strict=True))
    for i, k in enumerate(order):
        text, after = by[k] or "", by[order[(i + 1) % n]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[k].n_chars, got[k].edited) == (len(text), edited)
        own, new, follow = (prints(t) for t in (text, edited, after))
        assert got[k].near_edited == pytest.approx(like(own, new)) and got[k].near_next == pytest.approx(like(own, follow))
    if n == 40:
        plan = winnowing.compared(rows)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_next_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, "n"), (1, "b"), (1, "a"), (7, "z"), (None, "m")], "doc_id long, text string")
    got = winnowing.with_next(rows, "doc_id", "text", {"text": "after"}, part_rows=1).collect()
    assert {r.text: r.after for r in got} == {"z": "a", "a": "b", "b": "m", "m": "n", "n": "z"}


def test_png_filters():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, (40, 64)).astype("u1")
    lines, before = np.zeros((40, 65), "u1"), np.zeros(64, int)
    for y in range(40):
        kind, row = y % 5, samples[y].astype(int)
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, before, corner])
        guess = [0 * row, left, before, (left + before) // 2, paeth][kind]
        lines[y, 0], lines[y, 1:] = kind, (row - guess) % 256
        before = row
    assert (media.unfilter(lines) == samples).all()
    three = np.concatenate([lines, lines[:7], lines])
    assert (media.unfilter(three, 1, np.isin(np.arange(87), [0, 40, 47])) == np.concatenate([samples, samples[:7], samples])).all()
    assert (media.unfilter(lines[:1]) == samples[:1]).all() and media.unfilter(lines[:0]).shape == (0, 64)
    wide = samples.reshape(20, 128).astype(int)  # pixels of two bytes
    pixels, over = np.concatenate([np.zeros((20, 2), int), wide], 1), np.concatenate([np.zeros((1, 130), int), np.concatenate([np.zeros((20, 2), int), wide], 1)])[:-1]
    mean = np.concatenate([np.full((20, 1), 3), (wide - (pixels[:, :-2] + over[:, 2:]) // 2) % 256], 1).astype("u1")
    assert (media.unfilter(mean, 2) == wide).all()
    assert (media.read_png(media.write_png(samples.tobytes())) == samples).all()


def test_filters_are_chosen_by_least_differences(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    kinds = set()
    for r in media.store(d.union(docs(spark, ODD).select(*d.columns[:4], F.lit(0).cast("long")))).collect():
        lines = media.png_lines(bytes(r.media))
        kinds |= set(lines[:, 0].tolist())
        samples, above = media.read_png(bytes(r.media)).astype(int), [0] * 64
        for line, row in zip(lines[:20].tolist(), samples.tolist(), strict=False):
            sums = []
            for kind in range(5):
                total = 0
                for x in range(64):
                    a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
                    p = a + b - c
                    guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]
                    left = (row[x] - guess) % 256
                    total += min(left, 256 - left)
                sums.append(total)
            assert line[0] == sums.index(min(sums))
            above = row
    assert kinds == {0, 1, 2, 3, 4}


def test_cosine_hash():
    rng = np.random.default_rng(4)
    for n in (1, 5, 32, 77):
        a = rng.integers(0, 256, (n, 64)).astype("u1")
        small = np.zeros((32, 32))
        for y in range(32):
            for x in range(32):
                ys = [y * n // 32] if n < 32 else range(y * n // 32, (y + 1) * n // 32)
                small[y, x] = np.mean([[a[j, i] for i in (2 * x, 2 * x + 1)] for j in ys])
        low = [round(sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * v / 64) * np.cos(np.pi * (2 * x + 1) * u / 64) for y in range(32) for x in range(32)), 6) for v in range(8) for u in range(8)]
        middle = np.median(low[1:])
        bits = "".join(str(int(v > middle)) for v in low)
        assert media.cosine_hash(a) == int(bits, 2).to_bytes(8, "big")


def test_damaged_png():
    good = media.write_png(bytes(128))
    for bad in (b"", good[:-5], good[:40] + b"x" + good[41:], b"x" + good[1:]):
        with pytest.raises((ValueError, Exception)):
            media.read_png(bad)


def test_media(spark):
    got = media.stored_features(docs(spark, [*ODD, "a"])).orderBy("doc_id").collect()
    for r, text in zip(got, [*ODD, "a"], strict=True):
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])) and len(r.hash) == 8
    assert got[0].media_sha256 == got[1].media_sha256 and got[3].hash == got[-1].hash and media.stored_features(docs(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")


def test_archives(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "u", big), (9, "u", big), (4, None, big), (2, "x\r\ny", "small"), (3, "u", "small"), (5, "u", None), (5, "u", None), (7, "w", big + "7"), (7, "w", big + "7"), (None, "n", big), (None, "n", big + "n"), (None, "n", big + "n"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    got = warc.archived(pages(spark, rows)).collect()
    want = []
    for html in {r[2] or "" for r in rows}:
        same = [r[0] for r in rows if (r[2] or "") == html]
        raw = html.encode()
        top = max((p for p in same if p is not None), default=None)
        done = False
        for p in same:
            revisit = len(raw) >= 1000 and len(same) > 1 and (p != top or done)
            done = done or p == top
            want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    as_text = lambda x: sorted(map(str, x))
    assert as_text(want) == as_text((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert warc.archived(pages(spark, [])).count() == 0


def test_archive_files(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * 300) for i in range(30)]
    raw = warc.write(warc.roles(pages(spark, rows)).coalesce(1), f"file://{tmp_path}/raw", archive_bytes=20_000)
    assert raw.count() > 1
    done = warc.normalise(raw, f"file://{tmp_path}/out").collect()
    assert sum(r.n_records for r in done) == 30
    for r in done:
        data, index = (open(p.removeprefix("file://"), "rb").read() for p in (r.archive, r.sidecar))
        at = 0
        for line in index.decode().splitlines():
            offset, length, kind, _ = line.split("\t")
            assert int(offset) == at and warc.parse(data[at : at + int(length)])["record_type"] == kind
            at += int(length)
        assert at == len(data)
    for (path,) in raw.select("path").collect():
        data = open(path.removeprefix("file://"), "rb").read()
        assert b"".join(warc._inflated(io.BytesIO(data + data))) == 2 * gzip.decompress(data)
        for cut in (1, 8, len(data) // 2):
            with pytest.raises(ValueError, match="cut"):
                list(warc._inflated(io.BytesIO(data[:-cut])))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))


def test_pipeline(spark):
    import corpus_pipeline as cp

    extra = [(9000, None, "en", "s", 0), (9001, "123 456", "en", "s", 7), (9002, "only this text stands here alone", None, None, 32), (9002, "only this text stands here alone", None, None, 32)]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [d]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept[-1].withColumn("score", F.lit(1)).withColumn("fp", F.lit(2)), "")
        if i < 4:
            assert out.columns == list(cp.DOCUMENT_COLUMNS)
        kept.append(out.cache())
    before, lang, near, private, mixed, packed = ([r.asDict() for r in k.collect()] for k in kept)
    assert sorted(r["doc_id"] for r in lang) == sorted(r["doc_id"] for r in before if r["text"] and re.search(r"[^\W\d_]", r["text"]))
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {r["doc_id"]: shingles(r["text"]) for r in lang}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in near) == sorted(set(root.values()))
    key = lambda r: r["doc_id"]
    new = {r["doc_id"]: pii.pseudonymise(r["text"]) for r in near}
    for r, old in zip(sorted(private, key=key), sorted(near, key=key), strict=True):
        text, found = new[r["doc_id"]]
        assert r == old | {"text": text, "n_chars": len(text) if found else old["n_chars"]}
    assert any(found for _, found in new.values())
    own, size = {r["doc_id"]: r for r in private}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    times = Counter(r["doc_id"] for r in mixed)
    assert all(r == own[r["doc_id"]] for r in mixed) and max(times.values()) <= 3
    names = sorted({r["source"] for r in private if r["source"] is not None}) + [None]
    per = [[size(r["text"]) for r in private if r["source"] == s] for s in names]
    for s, sizes, target in zip(names, per, water([sum(p) for p in per], [1.0 + i % 3 for i in range(len(names))], 3.0), strict=True):
        taken = sum(n * size(own[i]["text"]) for i, n in times.items() if own[i]["source"] == s)
        assert abs(taken - target) <= 2 * max(sizes)
    encode, bins, cut = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode, {}, Counter()
    want = {i: np.array([*encode(own[i]["text"], add_special_tokens=False).ids, 0], "<u4") for i in times}
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        cut[r["doc_id"], r["piece"], r["start"], r["length"]] += 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert cut == Counter({(i, k, at, min(2048, len(ids) - at)): times[i] for i, ids in want.items() for k, at in enumerate(range(0, len(ids), 2048))})
    for items in bins.values():
        items.sort()
        assert [at for at, _ in items] == np.cumsum([0, *[n for _, n in items]])[:-1].tolist() and sum(items[-1]) <= 2048
    for stage in cp.STAGES[:4]:
        assert stage[1](spark, d.limit(0), "").count() == 0
