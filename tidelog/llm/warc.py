"""WARC archives: monolithic writer, per-record normaliser with sidecar index, reader.

``write_monolithic`` writes one gzip stream per partition. ``normalise`` inflates each
such stream once, piece by piece, rewrites every record as a gzip member of its own and
writes a sidecar file with a line ``offset length record-id`` for each. ``read_indexed``
seeks by those offsets. A task holds one record at a time, never a file. Files are
written under another name and then moved, so a repeated task leaves whole files only.
The folder must be one that pyarrow's file systems can open (file, s3, gs, hdfs).

A null or empty html is an empty payload; a null url leaves out the target URI. Of
records with equal payloads, that with the largest page_id is the response (null is
smaller than any); a repeated row with that page_id is a response as well.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, tidied, written

CHUNK = 1 << 20
#: Rows of a hot payload are spread over so many join keys.
SALTS = 32
FILES = "path string, index_path string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The headers of one record, its payload, and the payload's full length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return fields | {"payload": payload, "length": length}


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts inflated bytes, in pieces of any size, into whole records."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            length = next(int(x[15:]) for x in held[at:end].split(b"\r\n") if x.startswith(b"Content-Length:"))
            if len(held) < (stop := end + 4 + length + 4):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded pieces."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
            while inflate.eof and (data or inflate.unused_data):
                data, inflate = data or inflate.unused_data, zlib.decompressobj(31)
                yield inflate.decompress(data, CHUNK)
                data = inflate.unconsumed_tail
    yield inflate.flush()


class Moved:
    """An output file that gets its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.own, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        self.fs.delete_file(self.own) if kind else self.fs.move(self.own, self.path)


def write_monolithic(records_of: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, url, html, digest as hex, refers_to, revisit) into one gzip stream a partition; returns the files."""

    def write(batches):
        path, n, deflate = f"{folder}/{TaskContext.get().partitionId():06d}.mono.warc.gz", 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        first = next(batches, None)
        if first is None:
            return
        with Moved(path) as out:
            while first is not None:
                for page, url, html, digest, to, revisit in zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
                    name = base64.b32encode(bytes.fromhex(digest)).decode()
                    out.write(deflate.compress(record(page, url, (html or "").encode(), name, to, revisit)))
                    n += 1
                first = next(batches, None)
            out.write(deflate.flush())
        yield pa.RecordBatch.from_pydict({"path": [path], "index_path": [None], "records": [n]}, pa.schema([("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64())]))

    return records_of.mapInArrow(tidied(write), FILES)


def normalise(files: DataFrame) -> DataFrame:
    """Each monolithic file as a file of one member a record, and its sidecar index; returns the new files."""

    def one(path: str) -> tuple[str, str, int]:
        whole = path.removesuffix(".mono.warc.gz")
        new, index, at, n = f"{whole}.warc.gz", f"{whole}.idx", 0, 0
        source, name = fs.FileSystem.from_uri(path)
        with source.open_input_stream(name, compression=None) as stream, Moved(new) as out, Moved(index) as lines:
            for data in records(inflated(stream)):
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(data) + deflate.flush()
                out.write(member)
                lines.write(f"{at} {len(member)} {parse(data)['WARC-Record-ID']}\n".encode())
                at, n = at + len(member), n + 1
        return new, index, n

    def rewrite(batches):
        for batch in batches:
            new = [one(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "index_path", "records"), map(list, zip(*new)))) if new else {"path": [], "index_path": [], "records": []}, pa.schema([("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64())]))

    return files.mapInArrow(tidied(rewrite), FILES)


def read_indexed(files: DataFrame) -> DataFrame:
    """Every record of the normalised files, found by its offset."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()])))
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) not in ("", "None") else None

    def rows(path: str, index: str):
        source, name = fs.FileSystem.from_uri(path)
        with source.open_input_file(name) as data, source.open_input_stream(fs.FileSystem.from_uri(index)[1], compression=None) as lines:
            tail = b""
            while piece := lines.read(CHUNK):
                *whole, tail = (tail + piece).split(b"\n")
                for line in whole:
                    at, length, _ = line.split(b" ", 2)
                    data.seek(int(at))
                    x = parse(zlib.decompress(data.read(int(length)), 31))
                    url = x.get("WARC-Target-URI")
                    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    to = x.get("WARC-Refers-To")
                    if x["WARC-Type"] == "response":  # a revisit holds no payload to compare
                        digest = base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode()
                        if (len(x["payload"]), digest) != (x["length"], x["WARC-Payload-Digest"][5:]):
                            raise ValueError(f"{x['WARC-Record-ID']} in {path}: payload of {len(x['payload'])} bytes, sha1 {digest}, differs from its headers")
                    yield number(x["WARC-Record-ID"]), x["length"], x["WARC-Payload-Digest"][5:], x["WARC-Type"], number(to) if to else None, url, x["payload"]

    def read(batches):
        for batch in batches:
            held, size = [], 0
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist()):
                for row in rows(path, index):
                    held.append(row)
                    size += len(row[-1]) + 200
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.mapInArrow(tidied(read), READ)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with digest, refers_to and revisit. Hot payloads are pre-aggregated and their rows spread over salts; html moves once, by page."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    narrow = wide.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1")
    salt = F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(0)), F.lit(3)), F.lit(SALTS)).alias("salt")
    salted = shared.select("digest", "response", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    revisits = (
        narrow.withColumn("salt", salt).join(salted, ["digest", "salt"])
        .where(~F.col("page_id").eqNullSafe(F.col("response")))
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("response").alias("refers_to")).distinct()
    )
    joined = wide.join(revisits, wide["page_id"].eqNullSafe(revisits["p"]) & (wide["digest"] == revisits["d"]), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to", F.col("d").isNotNull().alias("revisit"))


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives, normalises those and reads them back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    mono = written(write_monolithic(with_revisits(pages, least_bytes), folder), "mono")
    n = max(1, mono.count())
    files = written(normalise(mono.repartition(n)), "warc-files")
    return read_indexed(files.repartition(n))


def op9(pages: DataFrame) -> DataFrame:
    """The digest of round_trip(): payloads of any size may be revisited."""
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """The rows of op9() as DuckDB SQL; base32 goes by 20 bits, four characters, at a time."""
    letter = lambda shift: f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> {shift}) & 31) + 1]"
    digits = "array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || h[5 * i + 1 : 5 * i + 5] AS BIGINT)), lambda v: " + " || ".join(map(letter, (15, 10, 5, 0))) + "), '')"
    return f"""
    SELECT page_id, n AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> r THEN r END AS refers_to
    FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS r FROM pages)"""
