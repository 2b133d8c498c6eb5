"""WARC archives: writing pages, normalising monolithic gzip files, reading back through the offset index.

write_archives() puts every page into a WARC file that is one gzip stream from start to end (what many crawlers
leave behind). Pages with equal payloads of 100 bytes or more are kept once, as the response of the smallest page
id; the others become revisit records that refer to it. normalise() inflates each such file once, as a stream, and
writes every record as a gzip member of its own, with a sidecar of one JSON line per record that holds the member's
offset and length. read_archives() fetches the members through the sidecar and checks each payload's digest.

Files are written under names of their own for each attempt of a task, and only the names that a finished task
returns are read later, so a lost executor costs its tasks and nothing else. A file takes file_bytes of records
before the next is begun, and is one task's work; a record goes through memory in pieces when normalised and whole
when read. Folders are URIs that pyarrow.fs opens (file, hdfs, s3, gs).

Defined cases: a null payload is empty; a null url has no target URI; records of pages without an id name none, and
are responses unless a page with an id has the same payload; rows that repeat a page id and a payload are all
responses; line breaks and blanks in a url are percent-encoded; other columns are not written; no pages, no files.
"""

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import new_folder, staged

LEAST_BYTES = 100
FILE_BYTES = 64 << 20
PIECE = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = re.compile(r"<urn:page:(-?\d+)>")


def with_first(pages: DataFrame, least=LEAST_BYTES) -> DataFrame:
    """page_id, url, body with the payload's digest and size, and the page that is the response of its equals."""
    rows = pages.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    equal = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    # a written table: the planner broadcasts it if it is small, and else both sides are dealt out and can be split
    equal = staged(equal, new_folder(pages.sparkSession, "equal-payloads"))
    return rows.join(equal, (F.col("digest") == F.col("same")) & (F.col("size") >= least), "left").drop("same")


def record(page_id, url, body: bytes, digest: str, first) -> bytes:
    revisit = first is not None and first != page_id
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}", f"WARC-Payload-Length: {len(body)}"]
    block = f"{HTTP}Content-Length: {len(body)}\r\n\r\n".encode() + (b"" if revisit else body)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", body_col="html", least=LEAST_BYTES, file_bytes=FILE_BYTES) -> DataFrame:
    """Writes monolithic files; gives their names and numbers of records (a written table)."""
    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        out = name = None
        held = n = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name, held, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = system.open_output_stream(f"{root}/whole/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(row[0], row[1], row[2].encode(), row[3], row[4])
                out.write(squeeze.compress(data))
                held, n = held + len(data), n + 1
                if held >= file_bytes:
                    yield done(out, squeeze, name, n)
                    out = None
        if out is not None:
            yield done(out, squeeze, name, n)

    def done(out, squeeze, name, n):
        out.write(squeeze.flush())
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    make_folder(folder, "whole")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{body_col}`").cast("string").alias("body"))
    return staged(with_first(rows, least).select("page_id", "url", "body", "digest", "first").mapInArrow(run, "file string, records long"), f"{folder}/whole-files")


def make_folder(folder: str, name: str) -> None:
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/{name}", recursive=True)


class Inflated:
    """The bytes of a gzip file of one or more members, in order, with a small buffer."""

    def __init__(self, source):
        self.source, self.held, self.inflate, self.rest = source, bytearray(), zlib.decompressobj(31), b""

    def fill(self) -> bool:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.rest or self.source.read(PIECE)
            more = self.inflate.decompress(data, PIECE)  # without data: what the last call had no room for
            if not data and not more:
                return False
            self.rest = self.inflate.unconsumed_tail
            if more:
                self.held += more
                return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        at = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("a record breaks off")
                return None
        return self.take(end + 4)

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def pieces(self, n: int):
        while n:
            if not self.held and not self.fill():
                raise ValueError("a record breaks off")
            out = self.take(min(n, len(self.held)))
            n -= len(out)
            yield out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def page_of(value: str | None):
    m = PAGE.fullmatch(value or "")
    return int(m[1]) if m else None


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file of whole/ as members/ with a sidecar; gives the new names (a written table)."""
    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            names = []
            for name in b.column(0).to_pylist():
                names.append(uuid.uuid4().hex)
                with system.open_input_stream(f"{root}/whole/{name}", compression=None) as source, \
                        system.open_output_stream(f"{root}/members/{names[-1]}.warc.gz", compression=None) as out, \
                        system.open_output_stream(f"{root}/members/{names[-1]}.index", compression=None) as index:
                    rewrite(Inflated(source), out, index)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    make_folder(folder, "members")
    # one file is one task's work at most
    spread = files.select("file").repartition(max(1, min(files.count(), 10_000)), "file")
    return staged(spread.mapInArrow(run, "file string"), f"{folder}/member-files")


def rewrite(source: Inflated, out, index) -> None:
    offset = 0
    while (head := source.head()) is not None:
        named, length = fields(head), 0
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

        def put(data):
            nonlocal length
            out.write(data)
            length += len(data)

        put(squeeze.compress(head))
        for piece in source.pieces(int(named["content-length"]) + 4):  # the block and the two line ends after it
            put(squeeze.compress(piece))
        put(squeeze.flush())
        line = {"offset": offset, "length": length, "type": named["warc-type"], "id": named["warc-record-id"], "digest": named.get("warc-payload-digest")}
        index.write(json.dumps(line).encode() + b"\n")
        offset += length


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/members/{name}.index", compression=None) as index, system.open_input_file(f"{root}/members/{name}.warc.gz") as source:
                    for line in lines(index):
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        rows.append(parsed(zlib.decompress(source.read(entry["length"]), 31)))
                        held += len(rows[-1][2] or b"")
                        if held > 4 * PIECE or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = files.select("file").repartition(max(1, min(files.count(), 10_000)), "file")
    return spread.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lines(source):
    rest = b""
    while data := source.read(PIECE):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def parsed(data: bytes):
    head, _, block = data.partition(b"\r\n\r\n")
    named = fields(head)
    block = block[:int(named["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, refers = named["warc-payload-digest"].removeprefix("sha256:"), None
    if named["warc-type"] == "revisit":
        payload, size, refers = None, int(named["warc-payload-length"]), page_of(named.get("warc-refers-to"))
    else:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {named['warc-record-id']} does not have its digest")
    return page_of(named["warc-record-id"]), named.get("warc-target-uri"), payload, size, digest, named["warc-type"], refers


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", body_col="html", least=LEAST_BYTES, file_bytes=FILE_BYTES, folder=None) -> DataFrame:
    """Writes, normalises and reads back; the archives stay in folder."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    whole = write_archives(pages, folder, id_col, url_col, body_col, least, file_bytes)
    return read_archives(normalise(whole, folder), folder)
