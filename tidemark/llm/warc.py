"""WARC archives and the monolithic gzip normaliser.

Archives that were compressed as one gzip stream can only be read from the start. The normaliser inflates each such file once, as a stream,
writes every record as a gzip member of its own, and gives a sidecar index of offsets, with which single records are read. Files
are written under another name and then moved. Archives are named by the task attempt that wrote them, and only those that Spark's own
table lists count, so attempts that were lost or repeated leave nothing that is read."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, settle, table, whole_text

#: Bytes of records, uncompressed, after which a writer begins a new archive.
ARCHIVE_BYTES = 1 << 30
CHUNK, LEVEL = 1 << 20, 5
#: Bytes of members that one task reads, about.
READ_BYTES = 16 << 20
GZIP = 16 + zlib.MAX_WBITS
ARCHIVES = "archive string, records long"
INDEX = "archive string, offset long, length long, record_id string, record_type string, issue string"
#: Ends of a head, with line feeds alone allowed.
HEAD_END = re.compile(rb"\r?\n\r?\n")
DIGESTS = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512, "md5": hashlib.md5}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Whole:
    """A file that is there under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _store(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of the response refers_to: then the block has the HTTP head alone, which still tells the payload's length."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values of a head's lines; a line that begins with white space goes on with the one before. Of a name that comes twice the last counts."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _length(head: dict[str, str]) -> int | None:
    n = head.get("content-length", "")
    return int(n) if re.fullmatch(r"[0-9]{1,18}", n) else None


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record. A block that isn't HTTP is the payload; a record without a good length ends where its data does."""
    end = HEAD_END.search(data)
    warc, rest = fields(data[: end.start()] if end else data), data[end.end() :] if end else b""
    block = rest[: _length(warc)]
    kind = warc.get("content-type", "").lower().replace(" ", "")
    if not kind.startswith("application/http") and warc.get("warc-type") not in ("response", "revisit", "request") or not re.match(rb"HTTP/|[A-Z]+ [^\r\n]* HTTP/", block):
        return warc, {}, block
    end = HEAD_END.search(block)
    return warc, fields(block[: end.start()] if end else block), block[end.end() :] if end else b""


def unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunks, or None if it isn't one."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        if len(out[-1]) < size:
            return None
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def has_digest(payload: bytes, told: str) -> bool | None:
    """Whether a payload has the digest that a record tells, in base 32 or 16; None for an algorithm that isn't known."""
    name, _, value = told.partition(":")
    if name.lower() not in DIGESTS:
        return None
    digest = DIGESTS[name.lower()](payload)
    return value.lower() == digest.hexdigest() or value.upper().rstrip("=") == base64.b32encode(digest.digest()).decode().rstrip("=")


def judged(data: bytes) -> tuple[dict[str, str], bytes, int | None, str | None, str | None]:
    """WARC fields, payload without its transfer coding, its length (of a revisit the length told), its SHA-1 in base 32 (of a revisit that told, if it is one), and what is wrong with it."""
    warc, http, payload = parse(data)
    told, issue = warc.get("warc-payload-digest"), None
    if warc.get("warc-type") == "revisit":
        name, _, value = (told or "").partition(":")
        if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
            value = base64.b32encode(bytes.fromhex(value)).decode()
        return warc, payload, _length(http), value.upper() if name.lower() in ("sha1", "sha-1") and re.fullmatch(r"[A-Za-z2-7]{32}", value) else None, None
    whole = payload
    if "chunked" in http.get("transfer-encoding", "").lower():
        plain = unchunked(payload)
        payload, issue = (payload, "CHUNKS_INVALID") if plain is None else (plain, None)
    if told and has_digest(payload, told) is False and has_digest(whole, told) is False:
        issue = issue or "DIGEST_MISMATCH"
    return warc, payload, len(payload), base32_sha1(payload), issue


def _inflated(stream) -> Iterator[bytes]:
    """What a gzip file of any number of members holds, in pieces."""
    inflate = None
    while data := stream.read(CHUNK):
        while data:
            inflate = inflate or zlib.decompressobj(GZIP)
            if out := inflate.decompress(data, CHUNK):
                yield out
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if inflate.eof:
                inflate = None
    while inflate and (out := inflate.decompress(b"", CHUNK)):
        yield out
    if inflate and not inflate.eof:
        raise ValueError("the gzip stream ends early")


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, str | None]]:
    """Records from pieces of a stream, each with its end mark, and what is wrong with it: LENGTH_MISSING (the rest of the stream is its block), TRUNCATED (the stream ends inside it) or STREAM_DAMAGED (it can't be inflated
    any further). Holds one record and one piece at most."""
    held = bytearray()
    ended, damaged = False, False

    def need(n: int) -> bool:
        nonlocal ended, damaged
        while len(held) < n and not ended:
            try:
                piece = next(pieces, None)
            except (ValueError, zlib.error, EOFError, OSError):
                piece, damaged = None, True
            if piece is None:
                ended = True
            else:
                held.extend(piece)
        return len(held) >= n

    def everything() -> None:
        while need(len(held) + 1):
            pass

    while need(1):
        # Records end with two line ends, but some writers give more or fewer.
        if blank := len(held) - len(held.lstrip(b"\r\n")):
            del held[:blank]
            continue
        at = 0
        while not (end := HEAD_END.search(held, at)):
            at = max(0, len(held) - 3)
            if not need(len(held) + 1):
                break
        size = _length(fields(bytes(held[: end.start()]))) if end else None
        if size is not None and need(end.end() + size):
            data = bytes(held[: end.end() + size])
            yield data + b"\r\n\r\n", None
            del held[: len(data)]
            continue
        everything()
        yield bytes(held) + b"\r\n\r\n", "STREAM_DAMAGED" if damaged else "TRUNCATED" if size is not None or not end else "LENGTH_MISSING"
        return
    if damaged:
        yield b"", "STREAM_DAMAGED"


def write_monolithic(pages: DataFrame, path: str, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row in archives that are one gzip stream each; gives archive, records.

    Of rows with equal payloads of min_bytes or more, that of the smallest page_id is a response (several rows of that id all are; null ids count
    only where there is no other) and others revisit it. Other columns of pages are left out, whatever their names. Groups are summed by digest before the shuffle and the rows are then joined to one row a group, a join
    that Spark splits where a payload is frequent."""
    rows = pages.select("page_id", "url", whole_text("html").alias("html")).withColumn("digest", F.sha2("html", 256))
    groups = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"))
    other = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    plan = rows.join(groups, "digest").select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get(), []
        out, name, squeeze, n, size = None, "", None, 0, 0

        def end() -> None:
            out.write(squeeze.flush())
            out.close()
            done.append((name, n))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, squeeze, n, size = _Whole(name), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                data = record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], date)
                out.write(squeeze.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    end()
                    out = None
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64()))], names=["archive", "records"])

    return settle(plan.mapInArrow(write, ARCHIVES), "warc-archives")


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite each archive with a member per record under path; gives the offset index, which is also stored there as the sidecar table.

    Archives may be anybody's: records of any type, without type or id (null), with other line ends. What can't be read on ends its archive with a record that has an issue (see _records); damage
    right after a whole record is a row of length 0. Archives of one name overwrite each other, so names must differ; no archives give an empty index."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{path}/{posixpath.basename(source)}"
                fs, at = _store(source)
                out, rows = _Whole(name), []
                with fs.open_input_stream(at, compression=None, buffer_size=CHUNK) as stream:
                    for data, issue in _records(_inflated(stream)):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(data) + squeeze.flush() if data else b""
                        end = HEAD_END.search(data)
                        head = fields(data[: end.start()]) if end else {}
                        rows.append((name, out.at, len(member), head.get("warc-record-id"), head.get("warc-type"), issue))
                        out.write(member)
                out.close()
                for lo in range(0, len(rows), 10_000):
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    spark = archives.sparkSession
    # A task an archive, by ranges of their names: the listing is a few bytes a file.
    archives.select("archive").repartitionByRange(max(1, archives.count()), "archive").mapInArrow(rewrite, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, target_uri string, issue string"


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), record_id, target_uri, issue, read member by member at the index's offsets.

    page_id and refers_to are null for ids that aren't those of op7's pages. The payload is what follows the HTTP head, without its transfer coding, or the block of a record that isn't HTTP; payload_digest its SHA-1 in base 32. issue: what the normaliser found, or
    CHUNKS_INVALID, or DIGEST_MISMATCH where the record tells a digest (SHA-1, SHA-2 or MD5, in base 32 or 16) that its payload hasn't. An index row of length 0 has nulls and its issue."""
    number = re.compile(r"<urn:page:(-?\d+)>")

    def page(x: str | None) -> int | None:
        return int(m[1]) if x and (m := number.fullmatch(x)) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if r["archive"] != name:
                    name = r["archive"]
                    fs, at = _store(name)
                    file = fs.open_input_file(at)
                if not r["length"]:
                    rows.append((None, None, None, None, None, None, None, None, r["issue"]))
                    continue
                warc, payload, n, digest, issue = judged(zlib.decompress(file.read_at(r["length"], r["offset"]), GZIP))
                kind, own = warc.get("warc-type"), warc.get("warc-record-id")
                rows.append((page(own), n, digest, kind, page(warc.get("warc-refers-to")), None if kind == "revisit" else payload, own, warc.get("warc-target-uri"), r["issue"] or issue))
                held += len(payload)
                if held > 8 * CHUNK:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    # Dealt by the bytes to be read, in a number of tasks that adaptive execution leaves alone: the index itself is small.
    tasks = 1 + (index.agg(F.sum("length").alias("n")).first()["n"] or 0) // READ_BYTES
    dealt = index.repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    index = normalise(write_monolithic(table(spark, sf_dir, "pages"), f"{path}/whole"), f"{path}/members")
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr(a, (('0x' || substr(h, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p, a
"""
