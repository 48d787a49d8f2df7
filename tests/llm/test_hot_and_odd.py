"""Repeated ids, null ids, hot rows and many partitions; secrets and finds against plain versions."""

import random
import re
import uuid
from collections import Counter

import pytest

pytest.importorskip("millrace.llm")
from pyspark.sql import functions as F

from millrace.llm import pii, warc
from millrace.llm.common import bounded_sample

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score int, fp int"
A, B, C = "the first text has words enough to be told apart from others", "another thing altogether that nobody else has written here", "and here is the third one with its own words in a row"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], FIELDS)


def kept(spark, rows):
    import corpus_pipeline as cp

    return sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, documents(spark, rows), "").collect()), key=str)


def test_near_duplicates_tell_documents_of_one_id_apart(spark):
    assert kept(spark, [(5, A), (9, A), (9, B), (11, C)]) == [(11, C), (5, A), (9, B)]
    assert kept(spark, [(None, A), (None, A), (None, B), (7, A)]) == [(7, A), (None, B)]
    assert kept(spark, [(3, A), (3, A), (3, A), (3, B), (3, B)]) == sorted([(3, A), (3, B)], key=str)
    assert kept(spark, [(1, None), (2, ""), (None, None), (4, A)]) == [(1, None), (4, A)]
    assert kept(spark, [(2, A + " x" * 2), (2, A + " x" * 2), (8, "")] + [(k, B) for k in range(20, 60)]) == sorted([(2, A + " x" * 2), (8, ""), (20, B)], key=str)


def test_stages_handle_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(None, A), (None, A), (None, None), (1, A), (1, B), (1, B), (2, ""), (3, "123"), (4, "word " * 40_000)]
    d = documents(spark, rows)
    assert Counter((r.doc_id, r.text) for r in cp.language_id(spark, d, "").collect()) == Counter((i, t) for i, t in rows if t and re.search("[a-z]", t))
    assert Counter((r.doc_id, r.text) for r in cp.pseudonyms(spark, d, "").collect()) == Counter(rows)
    mixed = cp.mix_sources(spark, d, "").collect()
    again = cp.mix_sources(spark, d.repartition(5), "").collect()
    assert Counter(mixed) == Counter(again) and {(r.doc_id, r.text) for r in mixed} <= set(rows)
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in mixed) - sum(words(t) for _, t in rows)) <= 2 * 40_000
    packed = cp.pack_sequences(spark, d, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in rows)


def test_mixed_copies_of_equal_rows_add_up(spark):
    import corpus_pipeline as cp

    rows = spark.createDataFrame([(1, A, "en", "a", 9)] * 60 + [(2, B, "en", "b", 9)] * 20 + [(3, C, "fr", None, 9)], FIELDS.split(", score")[0])
    found = Counter((r.source, r.lang) for r in cp.mix_sources(spark, rows, "").collect())
    total = 60 * len(A.split()) + 20 * len(B.split()) + len(C.split())
    limits = {"a": 180 * len(A.split()), "b": 60 * len(B.split()), None: 3 * len(C.split())}
    weight, target = {"a": 1, "b": 2, None: 3}, dict(limits)
    target["a"] = total - limits["b"] - limits[None] if limits["b"] < (total - limits[None]) * 2 / 3 else (total - limits[None]) / 3
    target["b"] = min(limits["b"], (total - limits[None]) * 2 / 3)
    assert weight and abs(found["a", "en"] * len(A.split()) - target["a"]) <= 2 * len(A.split()) and abs(found["b", "en"] * len(B.split()) - target["b"]) <= 2 * len(B.split()) and found[None, "fr"] == 3


def test_the_key_comes_from_the_caller(spark):
    import corpus_pipeline as cp

    d = documents(spark, [(1, "card 4111 1111 1111 1111")])
    with pytest.warns(UserWarning, match="key"):
        known = cp.pseudonyms(spark, d, "").first().text
    spark.conf.set(cp.KEY_SETTING, "mine")
    try:
        own = cp.pseudonyms(spark, d, "").first().text
    finally:
        spark.conf.unset(cp.KEY_SETTING)
    assert own == pii.pseudonymise("card 4111 1111 1111 1111", b"mine")[0] != known


def test_secrets_keep_their_format_and_link(spark):
    card, iban = "4111111111111111", "GB82WEST12345698765432"
    new = pii.pseudonymise(card)[0]
    assert pii.pseudonymise(f"secret: {card}") == (f"secret: {new}", [(8, 24, "card")])
    assert pii.pseudonymise(f"password: {iban} x")[0] == f"password: {pii.pseudonymise(iban)[0]} x"
    assert pii.pseudonymise("token=ab-2024-02-29-cdef")[0][9:19] == pii.pseudonymise("2024-02-29")[0]
    assert pii.pseudonymise("auth: longername123@example.com")[1] == [(6, 31, "email")]
    for value, shape in (("123456789012", "[0-9]+"), ("0000000000000", "[0-9]+"), ("deadbeef0123", "(?=.*[a-f])(?=.*[0-9])[0-9a-f]+"), ("abcdefabcdef", "[a-z]+"), ("Ab1_Cd2-Ef3+/", r"[A-Z][a-z]\d_[A-Z][a-z]\d-[A-Z][a-z]\d\+/")):
        out, found = pii.pseudonymise(f"password: {value}")
        assert re.fullmatch(f"password: {shape}", out) and len(out) == 10 + len(value) and out != f"password: {value}" and [k for *_, k in found] == ["secret"]


def test_pseudonyms_can_be_inverted():
    rng = random.Random(3)
    some = ["4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "2024-02-29", "29.02.2024", "123-45-6789", "(212) 555-1234", "+44 20 7946 0958", "+9 720 240 101", "192.168.1.77", "bob.k@example.com"]
    for value in some + ["token: " + "".join(rng.choice("abcdefABCxyz0123456789_/+-") for _ in range(rng.randint(12, 90))) for _ in range(300)]:
        out, found = pii.pseudonymise(f"x {value} y", b"k")
        assert found and pii.pseudonymise(out, b"k", inverse=True)[0] == f"x {value} y"


def plain_cards(text):
    """Every shortest reading of the rules: the leftmost, then longest, valid run of 13 to 19 digits."""
    out, at = [], 0
    while at < len(text):
        best = None
        if text[at].isdigit() and not (at and re.match(r"[0-9.-]", text[at - 1])):
            for end in range(len(text), at, -1):
                part = text[at:end]
                d = re.sub(r"\D", "", part)
                if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", part) and not re.match(r"[0-9]|-[0-9]", text[end:]) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 and len(set(d)) > 1:
                    best = best or end
        if best:
            out.append((at, best, "card"))
        at = best or at + 1
    return out


def test_cards_equal_a_plain_finder():
    rng, cards = random.Random(8), ["4111111111111111", "378282246310005", "6011 1111 1111 1117", "5555-5555-5555-4444", "4222222222222"]
    found = 0
    for _ in range(400):
        text = "".join(rng.choice([*cards, "a", ", ", "no. ", "x", "\n", "4111111111111112"]) + rng.choice(["", "", "; "]) for _ in range(5))
        want = plain_cards(text)
        found += len(want)
        assert [f[:3] for f in pii.numbers(text) if f[2] == "card"] == want, text
    assert found > 200


def test_ips_ssns_and_dates_equal_plain_finders():
    import datetime

    rng, found = random.Random(9), Counter()
    for _ in range(600):
        text = " ".join(rng.choice([f"{rng.randint(0, 300)}.{rng.randint(0, 300)}.1.{rng.randint(0, 9)}", f"{rng.randint(0, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}", f"20{rng.randint(10, 30)}-{rng.randint(0, 14):02d}-{rng.randint(0, 33):02d}", "word"]) for _ in range(4))
        want = []
        for m in re.finditer(r"\S+", text):
            w = m[0]
            if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", w) and all(int(x) < 256 for x in w.split(".")):
                want.append((*m.span(), "ip"))
            elif re.fullmatch(r"\d{3}-\d{2}-\d{4}", w) and 0 < int(w[:3]) < 900 and w[:3] != "666" and w[4:6] != "00" and w[7:] != "0000":
                want.append((*m.span(), "ssn"))
            elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", w):
                try:
                    datetime.date.fromisoformat(w)
                    want.append((*m.span(), "iso"))
                except ValueError:
                    pass
        found.update(k for *_, k in want)
        assert [f[:3] for f in pii.numbers(text)] == want, text
    assert min(found[k] for k in ("ip", "ssn", "iso")) > 100


def test_records_have_ids_of_their_own(spark):
    big = "<p>x</p>" * 300
    rows = [(None, "u", big), (None, "u", big), (None, "v", big + "1"), (4, "a", big), (4, "b", big), (4, "a", big), (4, "a", "small"), (4, "a", "small"), (4, "a", "other"), (2, "z", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = [warc.record(r.page_id, r.url, r.html, r.digest, r.n_bytes, r.turn, r.record_type == "revisit", r.refers_to, r.refers_url) for r in warc.roles(pages).collect()]
    heads = [next(warc.records(iter([m])))[0] for m in made]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(rows) and all(uuid.UUID(i[10:-1]) for i in ids)
    refers = {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"}
    lead = [h for h in heads if h["warc-record-id"] in refers]
    assert len(refers) == 1 and [(h["warc-type"], h["x-page"]) for h in lead] == [("response", "4")]


def test_many_copies_of_one_page(spark):
    big = "<p>y</p>" * 200
    pages = spark.range(9000).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit(big).alias("html"))
    got = Counter((r.record_type, r.refers_to) for r in warc.roles(pages).select("record_type", "refers_to").collect())
    assert got == {("response", None): 1, ("revisit", 7): 8999}


def test_samples_do_not_grow_with_partitions_or_copies(spark):
    rows = spark.range(0, 60_000, 1, 300).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("rare")).alias("g"), F.when(F.col("id") % 3 == 1, F.lit(5).cast("long")).otherwise(F.col("id")).alias("id"))
    rows = rows.withColumn("draw", F.xxhash64("id")).withColumn("text", F.concat(F.lit("t"), "id"))
    got = [(r.g, r.id, r.text) for r in bounded_sample(rows, 500, "g", "draw").collect()]
    every = rows.collect()
    for g in ("hot", "rare"):
        want = sorted((r.draw, r.id) for r in every if r.g == g)[:500]
        assert sorted(x[1] for x in got if x[0] == g) == sorted(i for _, i in want)
    assert all(t == f"t{i}" for _, i, t in got)
