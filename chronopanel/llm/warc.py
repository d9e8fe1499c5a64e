"""WARC archives: written from a table, indexed, and read back by byte range.

Writing: tasks append one compressed member per record to archives in the shared folder and
return one index row per record: file, offset, length, URL, digest. The index is a Parquet
table that Spark commits, so what a lost or repeated task attempt has written is never
referred to. Reading: records are selected on the index alone; their byte ranges are sorted
by file and offset, and ranges less than `gap` bytes apart are fetched in one read of at
most `span` bytes. Archives go through the file system that the folder's address names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.llm.common import columns, scratch, stage, utf8

#: Fixed values of the format.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder's address; a bare path is a local one."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _line(value: str) -> str:
    """A header value: line ends and controls as percent codes."""
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in value.encode())


def name_of(page, digest: str) -> str:
    return f"<urn:page:{'-' if page is None else page}:{digest}>"


def record(page, url: str | None, payload: bytes, digest: str, refers, is_revisit: bool, date: str) -> bytes:
    """One record. A revisit holds the HTTP header of its capture, payload length included, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {name_of(page, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name_of(refers, digest)}"] if is_revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The parts of a record of either type; page and refers_to as numbers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    out = {"type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload": None, "refers_to": None, "page_id": None, "bytes": None, "digest": None}
    if out["type"] == "warcinfo":
        return out
    number = lambda urn: None if (n := urn.split(":")[2]) == "-" else int(n)
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out |= {"page_id": number(fields["WARC-Record-ID"]), "bytes": told, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if out["type"] == "revisit":
        return out | {"refers_to": number(fields["WARC-Refers-To"])}
    return out | {"payload": payload, "bytes": len(payload), "digest": base32(hashlib.sha1(payload).hexdigest())}


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def roles(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Pages with payload and digest, each a response or a revisit of the smallest page_id.

    Null html is an empty payload. Payloads under `least` bytes are all responses. Rows that
    repeat the smallest id are responses too. Null ids come last: they revisit a page with
    an id; where a payload has none, all its rows are responses. Only digests are
    aggregated; groups of one need no row in the join.
    """
    rows = columns(pages, page_id=id, url=url, html=html)
    rows = rows.select("page_id", "url", utf8(F.col("html")).alias("payload")).withColumn("sha", F.sha1("payload"))
    light = rows.where(F.octet_length("payload") >= least).select("page_id", "sha")
    first = light.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first.drop("n"), "sha", "left").select("page_id", "url", "payload", "sha", F.when(again, F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll: int = 1 << 30) -> DataFrame:
    """Archive what `roles` returns under `folder`; returns the index. A file holds about `roll` bytes."""

    def run(batches):
        files, _ = store(folder)
        files.create_dir(store(folder)[1], recursive=True)
        out, path, at = None, None, 0
        for b in batches:
            index = []
            for page, url, payload, sha, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    # a name of its own for every attempt
                    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(store(path)[1], compression=None)
                    info = b"software: chronopanel\r\nformat: WARC File Format 1.1\r\n"
                    head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    at = out.write(_member(head.encode() + info + b"\r\n\r\n"))
                digest = base32(sha)
                member = _member(record(page, url, payload, digest, refers, refers is not None, date))
                out.write(member)
                kind = "response" if refers is None else "revisit"
                index.append((page, url, kind, refers, len(payload), digest, path, at, len(member)))
                at += len(member)
            yield _batch(index, INDEX)
        if out is not None:
            out.close()

    return stage(rows.select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(run, INDEX), "warc-index")


KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], KINDS[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def ranges(index, gap: int, span: int):
    """Sorted (offset, length) entries in runs that one read fetches."""
    run: list[tuple[int, int]] = []
    for offset, length in index:
        if run and (offset - (run[-1][0] + run[-1][1]) > gap or offset + length - run[0][0] > span):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read(index: DataFrame, payloads: bool = True, gap: int = 1 << 16, span: int = 1 << 23, stretch: int = 1 << 26) -> DataFrame:
    """The records that `index` selects, from their archives; `payloads` null if not wanted.

    Files are cut into stretches of `stretch` bytes, each read by one task in order. Of a
    response, length and digest are computed from the payload that was read. A record
    longer than `span` is read alone. An empty index gives an empty table.
    """
    where = index.select("file", (F.col("offset") / stretch).cast("long").alias("part"), "offset", "length")

    def run(batches):
        files, opened, name = None, None, None
        for b in batches:
            out = []
            entries = list(zip(*(b.column(c).to_pylist() for c in (0, 2, 3))))
            for path in dict.fromkeys(e[0] for e in entries):
                if path != name:
                    files, local = store(path)
                    opened, name = files.open_input_file(local), path
                for group in ranges([(o, n) for p, o, n in entries if p == path], gap, span):
                    first = group[0][0]
                    data = opened.read_at(group[-1][0] + group[-1][1] - first, first)
                    for o, n in group:
                        r = parse(zlib.decompress(data[o - first : o - first + n], 31))
                        out.append((r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"], r["payload"] if payloads else None))
                    if sum(len(x[5] or b"") for x in out) > span:
                        yield _batch(out, READ)
                        out = []
            yield _batch(out, READ)

    # index rows are tiny: tasks are counted by the bytes they will fetch
    tasks = int(index.agg(F.sum("length")).first()[0] or 0) // stretch + 1
    return where.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of archives that came from elsewhere: every file is scanned once, member by member."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, local = store(path)
                with files.open_input_stream(local, compression=None) as f:
                    at, rest = 0, b""
                    while rest or (rest := f.read(1 << 20)):
                        z, out, used = zlib.decompressobj(31), [], 0
                        while not z.eof:
                            out.append(z.decompress(rest))
                            used += len(rest) - len(z.unused_data)
                            rest = z.unused_data if z.eof else f.read(1 << 20)
                            if not rest and not z.eof:
                                raise ValueError(f"{path} ends inside a record")
                        r = parse(b"".join(out))
                        if r["type"] != "warcinfo":
                            yield _batch([(r["page_id"], r["url"], r["type"], r["refers_to"], r["bytes"], r["digest"], path, at, used)], INDEX)
                        at += used

    return names.repartition(F.col("path")).mapInArrow(run, INDEX)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **names) -> DataFrame:
    """Write the pages to archives and return their index.

    Empty tables make no archive and an empty index; repeated rows are archived each;
    other columns play no part.
    """
    return write(roles(pages, least=least, **names), folder or scratch(pages.sparkSession, "warc"))
