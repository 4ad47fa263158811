"""Operator 10: a converter of legacy ARC archives to WARC.

An ARC file begins with a ``filedesc`` line and a block of declared length whose first line gives the version. Version 1
records have the line ``URL IP date type length``, version 2 records ``URL IP date type status checksum location offset
file length``; the declared length alone says where content ends. URLs may hold blanks, so lines are split from the right.

Each record becomes a WARC record: an identifier from file name and position (the same in each run), the date as a
timestamp, a type (``response`` for HTTP content, ``resource`` for other content, ``revisit`` for equal payloads) and
SHA-1 digests of block and payload. Of records with equal payloads of at least ``least`` bytes, the one with the largest
page id stays whole, and the others keep their HTTP header only and refer to it.

All files are gzip, a member per record, written by tasks under names of their own into a shared folder.

Cases: a null html is an empty payload; a null URL is written as ``-``; a null page id is not written and comes back as
null, smaller than any; rows that repeat an id and its payload are told apart by file and position; an empty table gives
no files and no rows. A file that ends before a declared length raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_path
from .common import open_input, open_output, public_columns, text_slices

LEAST_BYTES = 1000
VERSION_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_SAFE = "%/:=&?~#+!$,;'@()*[]-._"


def _member(data: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


# ---- ARC


def arc_header(name: str, version: int, date: str) -> bytes:
    block = f"{version} 0 archive\n{VERSION_FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, at: int, name: str) -> bytes:
    middle = f" 200 - - {at} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{middle} {len(content)}\n".encode() + content + b"\n"


def _exactly(stream, length: int) -> bytes:
    data = stream.read(length)
    if len(data) < length:
        raise ValueError(f"the file ends {length - len(data)} bytes before a declared length")
    return data


def read_arc(stream) -> Iterator[tuple[int, str, str, str, str, bytes]]:
    """(position, URL, IP, date, content type, content) of each record of an uncompressed stream."""
    head = stream.readline()
    if not head:
        return
    if not head.startswith(b"filedesc://"):
        raise ValueError("not an ARC file")
    block = _exactly(stream, int(head.split()[-1]))
    version = int(block.split(None, 1)[0])
    if version not in VERSION_FIELDS:
        raise ValueError(f"ARC version {version}")
    fields = len(VERSION_FIELDS[version].split())
    at = len(head) + len(block)
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", fields - 1)
        if len(parts) != fields:
            raise ValueError(f"a record line of version {version} has {len(parts)} fields")
        content = _exactly(stream, int(parts[-1]))
        at += len(content)
        yield start, parts[0], parts[1], parts[2], parts[3], content


def _opened(path: str) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=open_input(path), mode="rb"), 1 << 18)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its empty line, and payload; no header where the content isn't HTTP."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, gap, payload = content.partition(b"\r\n\r\n")
    return head + gap, payload


def _page_id(header: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id: (-?[0-9]+)", header)
    return int(found[1]) if found else None


# ---- WARC


def warc_record(kind: str, record_id: str, date: str, uri: str, ip: str, block: bytes, content_type: str, payload_sha1: bytes | None, refers_to: str | None = None) -> bytes:
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    sha = lambda digest: "sha1:" + base64.b32encode(digest).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", stamp), ("WARC-Target-URI", uri), ("WARC-IP-Address", ip)]
    if refers_to:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    if payload_sha1 is not None:
        head.append(("WARC-Payload-Digest", sha(payload_sha1)))
    head += [("WARC-Block-Digest", sha(hashlib.sha1(block).digest())), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]))


def record_name(path: str, position: int) -> str:
    """Identifier of the record at a place of an archive."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit("/", 1)[-1]}#{position}')}"


# ---- jobs


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy archives of pages, one per task, versions 1 and 2 in turn; returns the table of files (path)."""
    rows = public_columns(pages, page_id=page_id, url=url, html=html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, at, version = "", None, 0, 1 + TaskContext.get().partitionId() % 2
        for batch in text_slices(batches, "html"):
            if stream is None:
                path, stream = open_output(folder, ".arc.gz")
                name = path.rsplit("/", 1)[-1]
                data = arc_header(name, version, date)
                at = stream.write(_member(data)) and len(data)
            for page, link, body in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), batch.column("html").cast(pa.binary()).to_pylist()):
                body = body or b""
                mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), mark) + body
                data = arc_record(version, quote(link or "-", safe=_SAFE), date, content, at, name)
                stream.write(_member(data))
                at += len(data)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return durable(rows.mapInArrow(run, "path string"), "arc-files")


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def index_arc(files: DataFrame) -> DataFrame:
    """(path, position, page_id, http, payload_bytes, sha1) of all records of the archives of ``files`` (path)."""
    names = ["path", "position", "page_id", "http", "payload_bytes", "sha1"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _opened(path) as stream:
                    for position, _, _, _, _, content in read_arc(stream):
                        header, payload = split_http(content)
                        rows.append((path, position, _page_id(header), bool(header), len(payload), hashlib.sha1(payload).digest()))
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return durable(_spread(files).mapInArrow(run, "path string, position bigint, page_id bigint, http boolean, payload_bytes bigint, sha1 binary"), "arc-index")


def choose_responses(index: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(path, position, sha1, to_path, to_position): where a record revisits another one, the place of that one.

    One row per digest is aggregated before the join; a digest that fills a third of all rows is a skewed key of a
    join with one row on the other side, which adaptive execution splits.
    """
    key = F.struct("page_id", "path", "position")
    large = index.filter(F.col("http") & (F.col("payload_bytes") >= least))
    best = large.groupBy("sha1", "payload_bytes").agg(F.max(key).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = best.select("sha1", "payload_bytes", F.col("best.path").alias("to_path"), F.col("best.position").alias("to_position"))
    joined = index.join(best, ["sha1", "payload_bytes"], "left")
    other = F.col("http") & ((F.col("path") != F.col("to_path")) | (F.col("position") != F.col("to_position")))
    return joined.select("path", "position", "sha1", F.when(other, F.col("to_path")).alias("to_path"), F.when(other, F.col("to_position")).alias("to_position"))


def convert_arc(choices: DataFrame, folder: str, n_files: int) -> DataFrame:
    """Write a WARC file for each archive of ``choices``; a group holds places and digests of one file's records only.

    The rows are few bytes each, so the number of tasks is given by the number of archives, not by their size.
    """

    def run(group: pa.Table) -> pa.Table:
        path = group.column("path")[0].as_py()
        plan = {p: (s, t, n) for p, s, t, n in zip(*(group.column(c).to_pylist() for c in ("position", "sha1", "to_path", "to_position")))}
        target, out = open_output(folder, ".warc.gz")
        count = 0
        with _opened(path) as stream:
            for position, url, ip, date, kind, content in read_arc(stream):
                header, _ = split_http(content)
                digest, to_path, to_position = plan[position]
                refers_to = record_name(to_path, to_position) if to_path else None
                block, warc_kind = (header, "revisit") if refers_to else (content, "response" if header else "resource")
                content_type = "application/http; msgtype=response" if header else kind
                if not count:
                    info = f"software: archive converter\r\nformat: WARC File Format 1.0\r\nsource: {path.rsplit('/', 1)[-1]}\r\n".encode()
                    out.write(_member(warc_record("warcinfo", record_name(path, -1), date, "-", ip, info, "application/warc-fields", None)))
                out.write(_member(warc_record(warc_kind, record_name(path, position), date, url, ip, block, content_type, digest, refers_to)))
                count += 1
        out.close()
        return pa.table({"path": [target], "records": pa.array([count], pa.int64())})

    return durable(choices.repartition(max(1, n_files), "path").groupBy("path").applyInArrow(run, "path string, records bigint"), "warc-files")


def read_warc_files(files: DataFrame) -> DataFrame:
    """(record_id, type, page_id, uri, date, payload_bytes, payload_digest, refers_to_id) of all records but ``warcinfo``.

    Length and digest are those of the full payload: of a revisit, what its HTTP and WARC headers state; else taken from
    the payload, which must agree with the stated digest.
    """
    names = ["record_id", "type", "page_id", "uri", "date", "payload_bytes", "payload_digest", "refers_to_id"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _opened(path) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        header, payload = split_http(block)
                        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "revisit":
                            length = int(re.search(rb"(?im)^Content-Length: ([0-9]+)", header)[1])
                        else:
                            length = len(payload)
                            if hashlib.sha1(payload).hexdigest() != stated:
                                raise ValueError(f"{fields['warc-record-id']}: the payload doesn't have the stated digest")
                        rows.append((fields["warc-record-id"], kind, _page_id(header), fields["warc-target-uri"], fields["warc-date"], length, stated, fields.get("warc-refers-to")))
                columns = list(zip(*rows)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "record_id string, type string, page_id bigint, uri string, date string, payload_bytes bigint, payload_digest string, refers_to_id string"
    return _spread(files).mapInArrow(run, schema)


def convert_archives(files: DataFrame, least: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Convert the ARC files of ``files`` (path) to WARC files; returns the table of those (path, records)."""
    folder = folder or shared_path(files.sparkSession, "warc")
    return convert_arc(choose_responses(index_arc(files), least), folder, files.count())


def archive_pages(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages through legacy archives into WARC files, and their records as read back, revisits with their page."""
    legacy = write_arc(pages, shared_path(pages.sparkSession, "arc"))
    records = durable(read_warc_files(convert_archives(legacy, least)), "warc-records")
    target = records.filter("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = records.filter("refers_to_id is not null").join(target, "refers_to_id", "left")
    rest = records.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(revisits)
