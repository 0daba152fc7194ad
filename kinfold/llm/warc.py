"""WARC archives: a deterministic sharded writer, and a reader.

Pages are sorted by range of page_id; a shard's range is written as files that roll over at a compressed size, each record a gzip
member of its own. Headers and SHA-256 digests are made anew from the payload. Of equal payloads of some size the smallest
page_id is a response and the others are revisits of it, without payload. Files get temporary names and are renamed; only those
that the manifest lists count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared
from .ranges import by_range, place
from .tokens import parts_of

#: Of records this long or longer, equal ones are stored once.
LEAST_BYTES = 100
ROLL_BYTES = 16_000_000
#: Archives don't depend on the clock.
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("5b1d9f6e-0f0c-4f5e-9c0a-5a3a4a7f6d21")
MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


COLUMNS = "page_id", "url", "html", "digest", "refers_to", "_id", "_tie"


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Page rows (page_id, url, html, digest; null url or html: empty) and mark rows (page_id, digest, refers_to; html null).

    A mark says that the page's payload of that digest is a revisit of another page. Marks come from ids and digests alone, so
    payloads are shuffled once, when both kinds are sorted. Rows with an equal page_id and payload are written each; null
    page_ids come first and are never referred to. A digest with many pages is pre-aggregated and its join can be split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha2("html", 256), "refers_to": F.lit(None).cast("long")})
    key, tie = place(F.col("page_id"), F.col("html"))
    rows = rows.withColumns({"_id": key, "_tie": tie})
    long_ = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest", "_id", "_tie")
    firsts = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    marks = long_.join(firsts, F.col("digest") == F.col("d")).where("page_id <> first").distinct()
    nothing = F.lit(None).cast("string")
    return rows.select(*COLUMNS), marks.select("page_id", nothing.alias("url"), nothing.alias("html"), "digest", F.col("first").alias("refers_to"), "_id", "_tie")


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """The record's bytes before compression."""
    key = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {key}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}:{digest}')}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 6, least: int = LEAST_BYTES, shard_bytes: int | None = None) -> list[dict]:
    """Writes the pages' archives and the manifest, a list of dicts in order of page_id; an empty table gives no file.

    Rows are in order of page_id, those of one page_id in order of a hash of their payload, then by url. Shards are ranges of that
    order, and archives are named by shard and number: the same pages give the same files, however they are dealt out.
    """
    shared.make_dir(folder)
    rows, marks = with_revisits(pages, least)
    ordered = by_range(rows, F.octet_length("html") + 300, marks, shard_bytes).sortWithinPartitions(
        "_shard", F.col("page_id").asc_nulls_first(), "_tie", F.col("refers_to").asc_nulls_last(), "url", "digest"
    ).select("_shard", "page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, part = [], None, 0
        out, records, size, digest = None, 0, 0, None
        marked: tuple[int | None, dict[str, int]] = (None, {})

        def close() -> None:
            nonlocal out, part
            if out is not None:
                out.commit()
                done.append({"file": name, "records": records, "bytes": size, "sha256": digest.hexdigest()})
                out, part = None, part + 1

        for whole in batches:
            for b in parts_of(whole, "html"):
                for shard, page_id, url, html, sha, refers_to in zip(*(b.column(k).to_pylist() for k in ("_shard", "page_id", "url", "html", "digest", "refers_to"))):
                    if shard != now:
                        close()
                        now, part = shard, 0
                    if html is None:  # a mark comes before the page's rows of that payload
                        if marked[0] != page_id:
                            marked = (page_id, {})
                        marked[1][sha] = refers_to
                        continue
                    refers_to = marked[1].get(sha) if page_id is not None and marked[0] == page_id else None
                    if out is None:
                        name = f"{now:06d}-{part:05d}.warc.gz"
                        out, records, size, digest = shared.Pending(folder, name), 0, 0, hashlib.sha256()
                    data = _member(record(page_id, url, html.encode(), sha, refers_to), level)
                    out.write(data)
                    digest.update(data)
                    records, size = records + 1, size + len(data)
                    if size >= roll_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)

    found = sorted((r.asDict() for r in ordered.mapInArrow(run, "file string, records long, bytes long, sha256 string").collect()), key=lambda r: r["file"])
    shared.write_file(folder, "manifest.json", json.dumps(found).encode())
    return found


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one after the other; it is fed in small steps, as what follows a member is copied."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("the archive ends in a record")
            out.append(d.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(d.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of a record; the block's digest is checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(h["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"][7:]:
        raise ValueError(f"digest of {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    h["payload"], h["payload_bytes"] = payload, int(http.rpartition(b": ")[2])
    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != h["WARC-Payload-Digest"][7:]:
        raise ValueError(f"payload of {h['WARC-Record-ID']}")
    return h


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to and url."""
    listed = spark.createDataFrame([(r["file"],) for r in manifest], "file string")
    n = max(1, min(len(manifest), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                for h in map(parse, members(shared.read_file(f"{folder}/{name}"))):
                    key, to = h["X-Page-ID"], h.get("X-Refers-To-Page-ID")
                    rows.append((None if key == "null" else int(key), h["payload_bytes"], h["WARC-Payload-Digest"][7:], h["WARC-Type"], to and int(to), h["WARC-Target-URI"]))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(READ.names, r)) for r in rows], schema=READ)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(READ.names, r)) for r in rows], schema=READ)

    return listed.repartition(n, F.col("file")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def write_and_read(pages: DataFrame) -> DataFrame:
    """The pages' records, read back from archives that are written to the shared folder first.

    A row for each row of pages, repeated ones too; null html is an empty payload, null url an empty one, and a null page_id is never
    referred to. An empty table gives no rows; other columns aren't read.
    """
    folder = shared.shared_dir(pages.sparkSession)
    return read(pages.sparkSession, folder, write(pages, folder))
