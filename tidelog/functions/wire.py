"""Catalog messages as tagged binary fields: varints, 64-bit numbers and length-prefixed bytes, defaults left out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import CodecError

#: Number, name and kind of each message's fields; statuses by number.
UNIT = ((1, "id", "text"), (2, "address", "text"))
SEGMENT = ((1, "ensemble", [UNIT]), (2, "start_offset", "number"))
TIMELINE = ((1, "name", "text"), (2, "timeline_id", "number"), (3, "status", ("ACTIVE", "SEALED")), (4, "term", "number"), (5, "version", "number"), (6, "lra", "number"))
REGISTRATION = ((1, "unit", UNIT), (2, "status", ("WRITABLE", "READONLY")), (3, "zone", "text"), (4, "cpu_usage", "double"), (5, "memory_usage", "double"), (6, "disk_usage", "double"))
VARINT, FIXED64, BYTES = 0, 1, 2


def varint(n: int) -> bytes:
    n, out = n % (1 << 64), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(message: dict, fields: tuple) -> bytes:
    out = bytearray()

    def put(number: int, kind: int, data: bytes):
        out.extend(varint(number << 3 | kind) + (varint(len(data)) if kind == BYTES else b"") + data)

    for number, name, kind in fields:
        value = message.get(name)
        if isinstance(kind, list):
            for each in value or ():
                put(number, BYTES, encode(each, kind[0]))
        elif value is None:
            continue
        elif kind == "text":
            put(number, BYTES, value.encode()) if value else None
        elif kind == "number":
            put(number, VARINT, varint(value)) if value else None
        elif kind == "double":
            put(number, FIXED64, struct.pack("<d", value)) if value else None
        elif isinstance(kind[0], str):
            put(number, VARINT, varint(kind.index(value))) if kind.index(value) else None
        else:
            put(number, BYTES, encode(value, kind))
    return bytes(out)


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise CodecError("a number is cut short")
        n, at, last = n | (data[at] & 127) << shift, at + 1, data[at] < 128
        if last:
            return n, at
        shift += 7


def _raw(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == VARINT:
            value, at = _number(data, at)
        elif tag & 7 in (FIXED64, BYTES):
            size, at = (8, at) if tag & 7 == FIXED64 else _number(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise CodecError(f"{size} bytes announced, {len(value)} there")
        else:
            raise CodecError(f"unknown kind {tag & 7}")
        yield tag >> 3, value


def decode(data: bytes, fields: tuple) -> dict:
    """The message's fields, defaults for those left out; unknown fields are skipped."""
    default = {"text": "", "number": 0, "double": 0.0}
    out = {name: [] if isinstance(kind, list) else default[kind] if isinstance(kind, str) else kind[0] if isinstance(kind[0], str) else None for _, name, kind in fields}
    known = {number: (name, kind) for number, name, kind in fields}
    for number, value in _raw(data):
        if number not in known:
            continue
        name, kind = known[number]
        if isinstance(kind, list):
            out[name].append(decode(value, kind[0]))
        elif kind == "text":
            out[name] = value.decode()
        elif kind == "number":
            out[name] = value - (1 << 64) if value >= 1 << 63 else value
        elif kind == "double":
            out[name] = struct.unpack("<d", value)[0]
        elif isinstance(kind[0], str):
            out[name] = kind[value]
        else:
            out[name] = decode(value, kind)
    return out


def encoded(rows: DataFrame, fields: tuple) -> DataFrame:
    """(message): each row's columns of the fields' names as bytes."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(r, fields) for r in b.to_pylist()], pa.binary())], names=["message"])

    return rows.mapInArrow(work, "message binary")


def decoded(rows: DataFrame, fields: tuple, schema: str) -> DataFrame:
    """The columns of (message), and its size as n_bytes; schema is theirs as DDL."""

    def work(batches):
        for b in batches:
            found = [decode(m, fields) | {"n_bytes": len(m)} for m in b.column("message").to_pylist()]
            if found:
                yield pa.RecordBatch.from_pylist(found)

    return rows.select("message").mapInArrow(work, f"{schema}, n_bytes long")
