"""WARC archives: monolithic gzip files, their normaliser, and reading by offset.

``write`` makes archives in which one gzip stream spans the whole file, as careless crawlers leave
them. ``normalise`` inflates such a file once, as a stream, writes every record again as a gzip member
of its own, and puts a sidecar index of offsets beside the archive. ``read`` opens the members by those
offsets. Memory holds one record at a time.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest page_id is a
response and the others are revisits of it. Only ids, urls and digests are shuffled to find that out, equal rows counted first;
the html of responses is dealt once, that of revisits never.

Files go to the shared folder under names that no other task or attempt uses; what a step returns
names the files of the attempt that succeeded, so lost executors leave stray files at most.

Defined results: a null html is an empty payload; a null url has no target; of repeated rows one is
the response; a null page_id is kept and is the response only if no other record has the payload; an
empty table gives no rows; a payload of any length is one record, held by a task one at a time; other columns are ignored.
A gzip stream or a record that is cut raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, ids_as_long, materialise, scratch

LEAST, DATE = 1000, "2000-01-01T00:00:00Z"
#: Bytes of records after which an archive is closed, and bytes read at a time.
ARCHIVE_BYTES, READ = 128 << 20, 1 << 20
RAW_LEVEL, LEVEL = 1, 6
#: Revisits of one row that are told apart at once.
BLOCK = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits for gzip framing


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with turn, n_bytes, digest (hexadecimal SHA-1), record_type, refers_to and refers_url (page and
    url of the response, which has turn 1). Equal rows are counted, so roles are told from ids, urls and digests
    alone; only the html of responses is dealt."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    keys = materialise(rows.groupBy("page_id", "url", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("_n")), "digests")
    first = keys.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("_first"), F.sum("_n").alias("_all")).where("_all > 1")
    told = keys.join(first.drop("_all"), "digest", "left")
    leads = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & F.col("url").eqNullSafe(F.col("_first.url"))
    responses = F.when(F.col("_first").isNull(), F.col("_n")).when(leads, F.lit(1)).otherwise(F.lit(0)).cast("long")
    told = materialise(told.select("page_id", "url", "digest", "n_bytes", "_n", responses.alias("_responses"), F.col("_first.page_id").alias("refers_to"), F.col("_first.url").alias("refers_url")), "roles")

    def with_html(some: DataFrame) -> DataFrame:
        side = some.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("digest").alias("_d"), "_n")
        same = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("digest") == F.col("_d"))
        return rows.join(side.hint("merge"), same).drop("_p", "_u", "_d")

    named = lambda df, kind: df.select("page_id", "url", "turn", "n_bytes", "html", "digest", F.lit(kind).alias("record_type"), "refers_to", "refers_url")
    no_one = {"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}
    # copies of one small page are records of their own, which nothing refers to: any number of their own will do
    own = F.when(F.col("_n") == 1, F.lit(1).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    out = named(with_html(told.where("_responses = _n")).withColumn("turn", own).withColumns(no_one), "response")
    led = told.where("_responses = 1 AND _n > 1")
    if not led.isEmpty():
        one = with_html(led).groupBy("page_id", "url", "digest", "n_bytes").agg(F.first("html").alias("html"))
        out = out.union(named(one.withColumn("turn", F.lit(1).cast("long")).withColumns(no_one), "response"))
    again = told.where("_n > _responses").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - F.col("_responses") - 1) / BLOCK))))
    begin = F.col("_responses") + 1 + F.col("_block") * BLOCK
    again = again.repartition("digest", "page_id", "url", "_block").withColumn("turn", F.explode(F.sequence(begin, F.least(begin + BLOCK - 1, F.col("_n")))))
    return out.union(named(again.withColumn("html", F.lit(None).cast("string")), "revisit"))


def _record_id(page_id: int | None, url: str | None, digest: str, turn: int) -> str:
    """Of page, url, payload and turn, so that different records never share an id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, url, digest, turn]))}>"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n_bytes: int, turn: int, revisit: bool, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url, digest, turn)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, refers_url, digest, 1)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"X-Page: {page_id}"] if page_id is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(path: str, write: bool = False):  # noqa: ANN202
    """A file of any store that pyarrow knows; Python's zlib alone packs and unpacks."""
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_file(name)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name, compression=None)


def _name(folder: str, kind: str) -> str:
    task = TaskContext.get()
    return f"{folder}/{kind}-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.warc.gz"


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``roles`` gives as monolithic archives: path, n_records, n_bytes of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = pack = None
        n = size = 0

        def close() -> pd.DataFrame:
            out.write(pack.flush())
            out.close()
            return pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            refers = [None if pd.isna(x) else int(x) for x in batch["refers_to"]]
            for page_id, refers_to, row in zip(ids, refers, batch.itertuples(), strict=True):
                if out is not None and size >= archive_bytes:
                    yield close()
                    out = None
                if out is None:
                    path = _name(folder, "raw")
                    out, pack, n, size = _open(path, True), zlib.compressobj(RAW_LEVEL, zlib.DEFLATED, _GZIP), 0, 0
                made = record(page_id, row.url, row.html, row.digest, row.n_bytes, row.turn, row.record_type == "revisit", refers_to, row.refers_url)
                out.write(pack.compress(made))
                n, size = n + 1, size + len(made)
        if out is not None:
            yield close()

    arrow_rows(records.sparkSession)
    as_text = {k: F.col(k).cast("string") for k in ("page_id", "refers_to")}
    return materialise(records.withColumns(as_text).mapInPandas(run, "path string, n_records long, n_bytes long"), "archives")


def _inflated(source) -> Iterator[bytes]:  # noqa: ANN001
    """The bytes of a gzip file, of one member or many, part by part."""
    unpack, open_ = zlib.decompressobj(_GZIP), False
    while block := source.read(READ):
        while block:
            piece, open_ = unpack.decompress(block), True
            if piece:
                yield piece
            block = unpack.unused_data
            if unpack.eof:
                unpack, open_ = zlib.decompressobj(_GZIP), False
    if open_:
        raise ValueError("a gzip stream is cut")


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, all bytes) of each record of an uncompressed stream."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(stream, None)
        if piece is None:
            ended = True
            return False
        held.extend(piece)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("incomplete WARC record")
                return
        lines = bytes(held[:at]).decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        end = at + 4 + int(headers["content-length"])
        while len(held) < end + 4:
            if not more():
                raise ValueError("incomplete WARC record")
        if held[end : end + 4] != b"\r\n\r\n" or not lines[0].startswith("WARC/"):
            raise ValueError("damaged WARC record")
        yield headers, bytes(held[at + 4 : end]), bytes(held[: end + 4])
        del held[: end + 4]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives (path) -> archive, sidecar and n_records of each archive with a member per record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["path"]:
                path, at, index = _name(folder, "archive"), 0, []
                with _open(source) as raw, _open(path, True) as out:
                    for headers, _, whole in records(_inflated(raw)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        index.append(f"{at}\t{len(member)}\t{headers['warc-type']}\t{headers['warc-record-id']}\n")
                        at += len(member)
                with _open(path + ".idx", True) as side:
                    side.write("".join(index).encode())
                yield pd.DataFrame({"archive": [path], "sidecar": [path + ".idx"], "n_records": [len(index)]})

    arrow_rows(archives.sparkSession)
    files = archives.count()
    dealt = archives.select("path").repartition(max(1, files))
    return materialise(dealt.mapInPandas(run, "archive string, sidecar string, n_records long"), "normalised")


def parse(member: bytes) -> dict:
    """page_id (as text), payload_bytes, payload_digest, record_type, refers_to and url of one gzip member."""
    headers, block, _ = next(records(iter([zlib.decompress(member, _GZIP)])))
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if revisit:
        n = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).partition(":")[2])
    else:
        n = len(payload)
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError("a payload does not have its digest")
    return {"page_id": headers.get("x-page"), "payload_bytes": n, "payload_digest": stated, "record_type": headers["warc-type"], "refers_to": headers.get("x-refers-to-page"), "url": headers.get("warc-target-uri")}


def read(archives: DataFrame) -> DataFrame:
    """archives (archive, sidecar) -> the records, each opened at its offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, sidecar in zip(batch["archive"], batch["sidecar"], strict=True):
                with _open(sidecar) as side:
                    places = [line.split("\t")[:2] for line in side.read().decode().splitlines()]
                with _open(path) as source:
                    for at in range(0, len(places), 1000):
                        rows = []
                        for offset, length in places[at : at + 1000]:
                            source.seek(int(offset))
                            rows.append(parse(source.read(int(length))))
                        yield pd.DataFrame(rows)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"
    arrow_rows(archives.sparkSession)
    return ids_as_long(archives.select("archive", "sidecar").repartition(max(1, archives.count())).mapInPandas(run, schema), "page_id", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, normalise the archives and read them back."""
    spark: SparkSession = pages.sparkSession
    folder = scratch(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(normalise(write(roles(pages), f"{folder}/raw"), f"{folder}/archives"))
