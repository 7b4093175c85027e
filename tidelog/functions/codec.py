"""Physical records: checksum, size, type, log number, data; little endian."""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..errors import CodecError

#: Record types by code, the header's layout, the largest data.
TYPES = ("ZERO", "FULL", "FIRST", "MIDDLE", "LAST")
HEADER = struct.Struct("<IHBI")
MOST_BYTES = 65535


def _checksum(code: int, number: int, data: bytes) -> int:
    return xxhash.xxh32_intdigest(struct.pack("<BI", code, number) + data, 0)


def encode_record(kind: str, number: int, data: bytes) -> bytes:
    if kind not in TYPES:
        raise CodecError(f"unknown record type {kind!r}")
    if len(data) > MOST_BYTES:
        raise CodecError(f"{len(data)} bytes of data; {MOST_BYTES} is the most")
    code = TYPES.index(kind)
    return HEADER.pack(_checksum(code, number, data), len(data), code, number) + data


def decode_record(raw: bytes, at: int = 0) -> tuple[str, int, bytes, int]:
    """(type, log number, data, bytes consumed) of the record that begins at at."""
    if len(raw) - at < HEADER.size:
        raise CodecError("too few bytes for a header")
    checksum, size, code, number = HEADER.unpack_from(raw, at)
    if code >= len(TYPES):
        raise CodecError(f"unknown record type {code}")
    data = bytes(raw[at + HEADER.size : at + HEADER.size + size])
    if len(data) < size:
        raise CodecError(f"{size} bytes of data announced, {len(data)} there")
    if (actual := _checksum(code, number, data)) != checksum:
        raise CodecError(f"checksum {actual}, expected {checksum}")
    return TYPES[code], number, data, HEADER.size + size


def decode_records(raw: bytes) -> list[tuple[str, int, bytes]]:
    """All records of a batch."""
    out, at = [], 0
    while at < len(raw):
        kind, number, data, used = decode_record(raw, at)
        out.append((kind, number, data))
        at += used
    return out


def encoded(rows: DataFrame) -> DataFrame:
    """rows (record_type, log_number, data, ...) with ``record`` instead of these three."""
    others = [c for c in rows.columns if c not in ("record_type", "log_number", "data")]
    schema = rows.select(*others).schema.add("record", "binary")

    def work(batches):
        for b in batches:
            found = [encode_record(k, n, d) for k, n, d in zip(*(b.column(c).to_pylist() for c in ("record_type", "log_number", "data")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(found, pa.binary())], names=[*others, "record"])

    return rows.mapInArrow(work, schema)


def decoded(rows: DataFrame) -> DataFrame:
    """The inverse of encoded(); a damaged record has its message in ``error`` and nulls."""
    others = [c for c in rows.columns if c != "record"]
    schema = rows.select(*others).schema.add("record_type", "string").add("log_number", "long").add("data", "binary").add("error", "string")

    def one(raw: bytes):
        try:
            return (*decode_record(raw)[:3], None)
        except CodecError as e:
            return None, None, None, str(e)

    def work(batches):
        for b in batches:
            found = [one(r) for r in b.column("record").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *columns], names=[*others, "record_type", "log_number", "data", "error"])

    return rows.mapInArrow(work, schema)
