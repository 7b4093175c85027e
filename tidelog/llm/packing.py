"""Packing of token ids into rows of fixed length by best-fit decreasing.

Each task encodes its documents, ends each with the end-of-text id, cuts those longer
than a row into whole rows and a rest (nothing is lost or repeated), and packs the rests,
longest first, each into the open row with the least room that suffices. A segment tree
over the room that is left answers that search. Documents are packed within groups of
some GROUP tokens, so that a task's memory is bounded and nothing is shuffled; a group of
thousands of documents leaves its rows all but full.

A packed row has the ids (little endian, 16 bits where the vocabulary allows, else 32;
padded with the model's pad id, or 0 where it has none), how many of them are tokens, cumulative segment lengths, the
position of each token in its segment (0 at each segment's begin; 16 bits where rows allow), and for each segment
its doc_id and the token of the document it begins at. A document without pieces (null
or empty text) has no segment. Null ids are carried along. Which documents share a row
depends on how the input is split into tasks; the documents' tokens do not.

The rows are written as binary matrices, one set of files for each task, each renamed when
it is whole, and can be read back in pieces.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, row_parts, tidied, written
from .pieces import Pieces, default_model, load_model, marked_text
from .warc import Moved

ROW = 2048
#: Tokens that are packed together.
GROUP = 4_000_000
PACKED = pa.schema([
    ("row_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
    ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
])
DDL = "row_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """Open rows by the room left in them; a segment tree finds the least room that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.tree[at]:
            self.tree[at] = True
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least need, which is no longer open then."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and not (at % 2 == 0 and self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while at and not (at < self.size and (self.tree[2 * at] or self.tree[2 * at + 1])):
                self.tree[at] = False
                at //= 2
        return room, row


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Items of each row, by index; no size is over most."""
    rooms, rows = Rooms(most), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = rooms.take(sizes[i])
        if got is None:
            got = most, len(rows)
            rows.append([])
        rows[got[1]].append(i)
        if got[0] > sizes[i]:
            rooms.add(got[0] - sizes[i], got[1])
    return rows


def position_type(most: int):
    return np.uint16 if most <= 1 << 16 else np.uint32


def packed_rows(docs: list[tuple[int | None, np.ndarray]], most: int, pad: int) -> Iterator[tuple[int, list, list, list, bytes, bytes]]:
    """Rows (tokens, doc_ids, doc_starts, cumulative lengths, ids, positions) of a group of documents."""
    parts = [(doc, at, ids[at : at + most]) for doc, ids in docs for at in range(0, len(ids), most)]
    for row in best_fit([len(p[2]) for p in parts], most):
        own = [parts[i] for i in row]
        ends = np.cumsum([0] + [len(p[2]) for p in own])
        ids = np.full(most, pad, own[0][2].dtype)
        ids[: ends[-1]] = np.concatenate([p[2] for p in own])
        positions = np.zeros(most, position_type(most))
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        yield int(ends[-1]), [p[0] for p in own], [p[1] for p in own], ends.tolist(), ids.tobytes(), positions.tobytes()


def pack(docs: DataFrame, model: str | None = None, most: int = ROW, group: int = GROUP, pad: int | None = None) -> DataFrame:
    """The packed rows of documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(load_model(model or default_model()))

    def work(batches):
        pieces = Pieces(*sent.value)
        kind = np.uint16 if pieces.sp.get_piece_size() <= 1 << 16 else np.uint32
        ending = np.array([pieces.sp.eos_id()], kind) if pieces.sp.eos_id() >= 0 else np.zeros(0, kind)
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        fill = max(0, pieces.sp.pad_id()) if pad is None else pad

        def flush(held):
            nonlocal number
            rows = []
            for row in packed_rows(held, most, fill):
                number += 1
                rows.append((number, *row))
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

        for part in row_parts(batches, "text", 2 << 20):
            texts = [marked_text(t or "") for t in part.column("text").to_pylist()]
            for i, found in zip(part.column("doc_id").to_pylist(), pieces.encode_all(texts)):
                ids = np.frombuffer(found, np.int32).astype(kind)
                if len(ids):
                    held.append((i, np.concatenate([ids, ending])))
                    size += len(ids)
            if size >= group:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(work), DDL)


FILES = "path string, n_rows long, ids_bytes long, positions_bytes long"
#: A row's number, and where its cumulative lengths begin; a segment's document, if it has an id, and the token it begins at.
ROWS, SEGMENTS = np.dtype([("row_id", "<i8"), ("at", "<i8")]), np.dtype([("known", "u1"), ("doc_id", "<i8"), ("start", "<i8")])


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Writes each partition's rows as `<n>.ids.bin` and `<n>.positions.bin` (row-major matrices), `<n>.cu_seqlens.bin` (all rows' cumulative
    lengths, 32 bits), `<n>.segments.bin` (SEGMENTS) and `<n>.rows.bin` (ROWS); returns the path without these endings, the number of rows and
    the bytes of a row in both matrices. The folder must be one that pyarrow's file systems can open."""

    def write(batches):
        path, n, at, widths = f"{folder}/{TaskContext.get().partitionId():06d}", 0, 0, None
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with contextlib.ExitStack() as open_files:
            ids, positions, lengths, segments, rows = (open_files.enter_context(Moved(f"{path}.{x}.bin")) for x in ("ids", "positions", "cu_seqlens", "segments", "rows"))
            for batch in itertools.chain([first], batches):
                for row, i, p, c, docs, starts in zip(*(batch.column(x).to_pylist() for x in ("row_id", "ids", "positions", "cu_seqlens", "doc_ids", "doc_starts"))):
                    widths = len(i), len(p)
                    ids.write(i)
                    positions.write(p)
                    lengths.write(np.array(c, "<i4").tobytes())
                    segments.write(np.array([(d is not None, d or 0, s) for d, s in zip(docs, starts)], SEGMENTS).tobytes())
                    rows.write(np.array([(row, at)], ROWS).tobytes())
                    at, n = at + len(c), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((path, pa.string()), (n, pa.int64()), (widths[0], pa.int64()), (widths[1], pa.int64()))], names=["path", "n_rows", "ids_bytes", "positions_bytes"])

    return packed.mapInArrow(tidied(write), FILES)


def read_matrices(files: DataFrame) -> DataFrame:
    """The rows that write_matrices() wrote, a few hundred at a time."""

    def read(batches):
        for path, n, ids_bytes, positions_bytes in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            fs, base = pyarrow.fs.FileSystem.from_uri(path)
            with contextlib.ExitStack() as open_files:
                ids, positions, lengths, segments, rows = (open_files.enter_context(fs.open_input_stream(f"{base}.{x}.bin", compression=None)) for x in ("ids", "positions", "cu_seqlens", "segments", "rows"))
                ahead = rows.read(ROWS.itemsize)
                for first in range(0, n, 256):
                    here = min(256, n - first)
                    block = np.frombuffer(ahead + rows.read(ROWS.itemsize * here), ROWS)  # with the row after the block, if there is one
                    ahead = block[here:].tobytes()
                    ends = block["at"] - block["at"][0]
                    held = np.frombuffer(lengths.read(4 * int(ends[here])) if len(block) > here else lengths.read(), "<i4")
                    ends = np.append(ends[:here], len(held))
                    own = np.frombuffer(segments.read(SEGMENTS.itemsize * (len(held) - here)), SEGMENTS)
                    out = []
                    for k in range(here):
                        c, s = held[ends[k] : ends[k + 1]], own[ends[k] - k : ends[k + 1] - k - 1]
                        docs = [d if known else None for known, d in zip(s["known"].tolist(), s["doc_id"].tolist())]
                        out.append((int(block["row_id"][k]), int(c[-1]), docs, s["start"].tolist(), c.tolist(), ids.read(ids_bytes), positions.read(positions_bytes)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED)

    return files.repartition(max(1, files.count())).mapInArrow(tidied(read), DDL)  # a task for each, however short their rows are


def op1(docs: DataFrame) -> DataFrame:
    """Every packed row as it stands in the written matrices, its positions as a checksum."""
    folder = fresh_path(docs.sparkSession, "matrices")
    files = written(write_matrices(pack(docs), folder), "files")
    return read_matrices(files).withColumn("positions_sha256", F.sha2("positions", 256)).drop("positions")
