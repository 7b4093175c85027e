"""Segment files: physical records one behind the other, in files of bounded size.

A plain file has records only. An aligned one pads each write with zero bytes to a
multiple of ALIGNED; a reader that finds zeros, and no record, goes on at the next
multiple.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..errors import CodecError
from .codec import HEADER, decode_record, encode_record

#: Bytes of a segment file, and what aligned writes are padded to.
MOST_BYTES, ALIGNED = 64 << 20, 4096


class SegmentWriter:
    """Appends records to an open file; a record that does not fit belongs to the next file."""

    def __init__(self, file, most: int = MOST_BYTES, aligned: bool = False):
        self.file, self.most, self.aligned, self.at = file, most, aligned, 0

    def append(self, records: list[bytes]) -> int | None:
        """Where the records begin, or None if they do not fit a file that has some."""
        data = b"".join(records)
        if self.aligned:
            data += b"\0" * (-len(data) % ALIGNED)
        if self.at and self.at + len(data) > self.most:
            return None
        at, self.at = self.at, self.at + len(data)
        self.file.write(data)
        return at


class SegmentReader:
    """The records of a file's bytes."""

    def __init__(self, data: bytes, aligned: bool = False):
        self.data, self.aligned = data, aligned

    def read_at(self, at: int) -> tuple[str, int, bytes, int]:
        """(type, log number, data, where the next one may begin)."""
        if not 0 <= at < len(self.data):
            raise CodecError(f"{at} is beyond the {len(self.data)} bytes written")
        kind, number, data, used = decode_record(self.data, at)
        return kind, number, data, at + used

    def read_all(self) -> Iterator[tuple[str, int, bytes]]:
        at = 0
        while at < len(self.data):
            left = -at % ALIGNED
            blank = self.aligned and left and not self.data[at : at + min(left, HEADER.size)].strip(b"\0")
            try:
                kind, number, data, at = self.read_at(at)
            except CodecError:
                if not blank:
                    raise
                at += left
                continue
            yield kind, number, data


def write_segments(rows: DataFrame, folder: str, most: int = MOST_BYTES, aligned: bool = False) -> DataFrame:
    """Writes rows (record_type, log_number, data), each partition to files of its own; (path, n, size). The folder must be one that pyarrow's file systems can open."""

    def write(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        found, path, file, writer, n = [], None, None, None, 0

        def close():
            if file is not None:
                file.close()
                fs.move(f"{path}.part", path)  # a file is there whole or not at all
                found.append((path, n, writer.at))

        for b in batches:
            for record in zip(*(b.column(c).to_pylist() for c in ("record_type", "log_number", "data"))):
                raw = [encode_record(*record)]
                if writer is None or writer.append(raw) is None:
                    close()
                    path, n = f"{base}/{uuid.uuid4().hex}.seg", 0
                    file = fs.open_output_stream(f"{path}.part")
                    writer = SegmentWriter(file, most, aligned)
                    writer.append(raw)
                n += 1
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "n", "size"])

    return rows.select("record_type", "log_number", "data").mapInArrow(write, "path string, n long, size long")


def read_segments(spark: SparkSession, folder: str, aligned: bool = False) -> DataFrame:
    """(record_type, log_number, data) of all files of a folder; a task reads a file at a time."""

    def read(batches):
        for b in batches:
            for content in b.column("content"):
                rows = list(SegmentReader(content.as_py(), aligned).read_all())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["record_type", "log_number", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(folder)
    return files.select("content").mapInArrow(read, "record_type string, log_number long, data binary")
