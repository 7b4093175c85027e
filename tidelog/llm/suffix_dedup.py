"""Exact substring dedup over all documents by deep-shallow suffix sorting.

Every byte covered by a WINDOW-byte string that also starts earlier (in a document of
smaller id, or earlier in the same one) is removed. Only places that can matter are
sorted: in each window the leftmost least hash of its GRAM-byte grams is an anchor, so
equal windows have equal anchors at equal places. The steps, each a shuffle of packed
arrays:

1. anchors of all texts, by hash; those that occur once are dropped;
2. the others fetch their context (what a window round the anchor can hold) from their
   document; equal contexts of one task are settled there, the earliest stands for them;
3. contexts meet by hash and are sorted, to the right of the anchor and to the left of
   it: multikey quicksort on eight-byte characters down to SHALLOW bytes, then a blind
   trie for each group that still ties. From both orders and their common prefixes
   follows, for every window round an anchor, whether an earlier place holds it;
4. what is covered meets its document again and is cut out.

An anchor that occurs HOT_LEAST times and more than one anchor in HOT_SHARE is hot; its
windows skip 1 to 3 and are compared one by one, by a 128-bit hash that is first reduced
within each task, so that no group grows with a passage that a third of all documents
share. The result is the same either way.

Rows are dealt by hash or document into buckets of about BUCKET_BYTES of text; a partition
takes its buckets one after the other, so that a task holds one bucket's packed rows,
whatever the input.

A null text is empty. Rows that share a doc_id count as one document: of their places
that with the smaller start is earlier, and equal starts do not cover each other. A null
doc_id comes after all others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, even, nested, parts_of, row_parts, tidied, written

WINDOW, GRAM = 100, 20
LEFT = WINDOW - GRAM
SPAN = LEFT + WINDOW
SHALLOW = 32
HOT_LEAST, HOT_SHARE = 20_000, 2000
#: Text whose anchors one bucket takes, about.
BUCKET_BYTES = 64 << 20
#: Texts longer than this are searched in pieces that overlap by a window.
PIECE = 1 << 20
#: Anchors and contexts a task holds before it sends them on.
HELD_ANCHORS, HELD_CONTEXTS = 400_000, 50_000
PLACE = np.uint64((1 << 24) - 1)
TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]
ROW = "kind int, bucket int, blob binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
ANCHORS, WINDOWS, REQUESTS, CONTEXTS, MARKS = range(5)
#: Columns of each kind of blob.
LAYOUT = {
    ANCHORS: ("u8", "i8", "u4", "i8"),  # hash, document, checksum of its text, place
    WINDOWS: ("u8", "u8", "i8", "u4", "i8"),  # hash, hash, document, checksum, start
    REQUESTS: ("u8", "i8", "u4", "i8"),
    CONTEXTS: ("u8", "i8", "u4", "i8", f"V{SPAN}", "u1", "u1"),  # ..., bytes, how many are there left and right of the anchor's start
    MARKS: ("i8", "u4", "i8", "i8"),  # document, checksum, start, end
}


def pack(columns) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(kind: int, blobs: list[bytes]) -> list[np.ndarray]:
    parts = [[np.zeros(0, t)] for t in LAYOUT[kind]]
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int.from_bytes(data[:8], "little"), 8
        for held, t in zip(parts, LAYOUT[kind]):
            held.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def dealt(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns' rows as a blob for each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = [(kind, int(bucket[at[0]]), pack([c[at] for c in columns])) for at in np.split(order, cuts)]
    for i in range(0, len(rows), 64):
        yield batch(rows[i : i + 64])


def doc_bucket(doc: np.ndarray, check: np.ndarray, buckets: int) -> np.ndarray:
    """By document and checksum of the text, so that rows of one id, or of none, are dealt as well."""
    d = doc.view(np.uint64)
    d = d ^ (d >> np.uint64(7)) ^ (d >> np.uint64(19)) ^ check.astype(np.uint64)
    return (d.view(np.int64) % buckets).astype(np.int32)


def doc_bucket_column(buckets: int) -> F.Column:
    d, check = F.col("_doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return F.pmod(d.bitwiseXOR(F.shiftrightunsigned(d, 7)).bitwiseXOR(F.shiftrightunsigned(d, 19)).bitwiseXOR(check), F.lit(buckets)).cast("int")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[4]
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h1 = TABLE[data]
    h2 = h1[:-1] * ODD[0] + h1[1:]
    h4 = h2[:-2] * ODD[1] + h2[2:]
    h8 = h4[:-4] * ODD[2] + h4[4:]
    h16 = h8[:-8] * ODD[3] + h8[8:]
    n = len(data) - GRAM + 1
    return mixed(h16[:n] * ODD[5] + h4[16 : 16 + n])


def window_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of WINDOW bytes."""
    a, b = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        c = TABLE[rows[:, k]]
        a = a * ODD[0] + c
        b = (b ^ c) * ODD[6]
        b ^= b >> np.uint64(32)
    return mixed(a), mixed(b)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text's index and place of each anchor."""
    pieces = [(i, at, t[at : at + PIECE + WINDOW - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - WINDOW + 1), PIECE) if len(t) >= WINDOW]
    out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    first = 0
    while first < len(pieces):
        last, size = first, 0
        while last < len(pieces) and (size == 0 or size + len(pieces[last][2]) <= PIECE + WINDOW):
            size += len(pieces[last][2])
            last += 1
        part = pieces[first:last]
        first = last
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        starts = np.cumsum(sizes) - sizes
        h = gram_hashes(data)
        low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: -(LEFT + 1 - 64)], low[LEFT + 1 - 64 :])  # over LEFT + 1 grams
        piece = np.repeat(np.arange(len(part)), sizes)[: len(low)]
        inside = np.arange(len(low)) + WINDOW <= (starts + sizes)[piece]
        at = (low[inside] & PLACE).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        piece = np.searchsorted(starts, at, side="right") - 1
        out[0].append(h[at])
        out[1].append(np.array([p[0] for p in part])[piece])
        out[2].append(at - starts[piece] + np.array([p[1] for p in part])[piece])
    return tuple(map(np.concatenate, out))


def texts_of(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bytes, document and checksum of each row."""
    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
    return texts, part.column("_doc").to_numpy(), np.array([zlib.crc32(t) for t in texts], np.uint32)


def contexts(text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LEFT bytes before and WINDOW bytes from each place on, and how many of each the text has."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), np.frombuffer(text, np.uint8), np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at]
    return rows, np.minimum(at, LEFT).astype(np.uint8), np.minimum(len(text) - at, WINDOW).astype(np.uint8)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of the anchors that are a large share of all: HOT_SHARE at most, whatever the input."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])

    def count(batches):
        held, total = [np.zeros(0, np.uint64)], 0
        found: dict[int, int] = {}

        def fold():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for i in np.flatnonzero(n > max(1, n.sum() // (2 * HOT_SHARE))):
                found[int(h[i])] = found.get(int(h[i]), 0) + int(n[i])

        for part in row_parts(batches, "text", PIECE):
            h, _, _ = anchors([(t or "").encode() for t in part.column("text").to_pylist()])
            held.append(h)
            total += len(h)
            if sum(map(len, held)) > HELD_ANCHORS:
                fold()
                held = [np.zeros(0, np.uint64)]
        fold()
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: 4 * HOT_SHARE]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in top] or [0], np.uint64).view(np.int64)), pa.array([n for _, n in top] or [0], pa.int64()), pa.array([total] + [0] * (max(1, len(top)) - 1), pa.int64())], schema=schema)

    rows = docs.select("text").mapInArrow(tidied(count), "h long, n long, total long")
    summed = rows.groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {HOT_LEAST}")
    found = summed.orderBy(F.desc("n")).limit(HOT_SHARE).collect()
    total = rows.agg(F.sum("total")).first()[0] if found else 0
    return np.sort(np.array([r["h"] for r in found if r["n"] > total // HOT_SHARE], np.int64).view(np.uint64))


def find_anchors(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed anchors, and for hot ones their windows and what a task can settle of them."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_SHARE hashes at most

    def work(batches):
        hot, held, size = sent.value, [], 0
        for part in row_parts(batches, "text", PIECE):
            texts, doc, check = texts_of(part)
            h, i, at = anchors(texts)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                yield from hot_windows(texts, doc, check, i[is_hot], at[is_hot], buckets)
                h, i, at = h[~is_hot], i[~is_hot], at[~is_hot]
            held.append((h, doc[i], check[i], at))
            size += len(h)
            if size > HELD_ANCHORS:
                columns = [np.concatenate(c) for c in zip(*held)]
                yield from dealt(ANCHORS, (columns[0] % np.uint64(buckets)).astype(np.int32), columns)
                held, size = [], 0
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from dealt(ANCHORS, (columns[0] % np.uint64(buckets)).astype(np.int32), columns)

    return docs.select("_doc", "text").mapInArrow(tidied(work), ROW)


def hot_windows(texts, doc, check, i, at, buckets) -> Iterator[pa.RecordBatch]:
    """Windows round hot anchors, the earliest of each kind; later ones of the same part are marked here."""
    held, size = [], 0

    def reduced():
        a, b, d, c, s = (np.concatenate(x) for x in zip(*held))
        order, first, later = earliest(a, b, d, s)
        yield from marks(d[order][later], c[order][later], s[order][later], s[order][later] + WINDOW, buckets)
        keep = order[~later]
        yield from dealt(WINDOWS, (a[keep] % np.uint64(buckets)).astype(np.int32), [x[keep] for x in (a, b, d, c, s)])

    for k in np.unique(i):
        text = texts[k]
        own = at[i == k]
        starts = np.unique((own[:, None] - np.arange(LEFT + 1)).ravel())
        starts = starts[(starts >= 0) & (starts + WINDOW <= len(text))]
        for cut in range(0, len(starts), 200_000):
            s = starts[cut : cut + 200_000]
            a, b = window_hashes(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), WINDOW)[s])
            held.append((a, b, np.full(len(s), doc[k]), np.full(len(s), check[k]), s))
            size += len(s)
            if size > 400_000:
                yield from reduced()
                held, size = [], 0
    if held:
        yield from reduced()


def earliest(a, b, doc, start):
    """An order by both hashes and place, the first of each row's run, and which rows come later than it."""
    order = np.lexsort((start, doc, b, a))
    begins = np.ones(len(order), bool)
    begins[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    same = (doc[order] == doc[order][first]) & (start[order] == start[order][first])
    return order, first, ~same


def marks(doc, check, start, end, buckets: int) -> Iterator[pa.RecordBatch]:
    yield from dealt(MARKS, doc_bucket(doc, check, buckets), [doc, check, start, end])


def by_kind(batches) -> Iterator[dict[int, list[bytes]]]:
    """Each bucket's blobs, of rows sorted by bucket."""
    bucket, out = None, {}
    for b in batches:
        for number, kind, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            if number != bucket:
                if out:
                    yield out
                bucket, out = number, {k: [] for k in LAYOUT}
            out[kind].append(blob)
    if out:
        yield out


def in_buckets(rows: DataFrame) -> DataFrame:
    """Each partition's buckets one after the other."""
    return even(rows, "bucket", parts_of(rows.sparkSession)).sortWithinPartitions("bucket")


def repeated(found: DataFrame, buckets: int) -> DataFrame:
    """Requests for the anchors that occur more than once; marks for hot windows."""

    def work(batches):
        for blobs in by_kind(batches):
            for blob in blobs[MARKS]:
                d, c, s, e = unpack(MARKS, [blob])
                yield from marks(d, c, s, e, buckets)
            h, d, c, at = unpack(ANCHORS, blobs.pop(ANCHORS))
            order = np.argsort(h, kind="stable")
            h = h[order]
            twice = np.zeros(len(h), bool)
            twice[1:] = h[1:] == h[:-1]
            twice[:-1] |= twice[1:]
            order = order[twice]
            yield from dealt(REQUESTS, doc_bucket(d[order], c[order], buckets), [h[twice], d[order], c[order], at[order]])
            a, b, d, c, s = unpack(WINDOWS, blobs.pop(WINDOWS))
            order, _, later = earliest(a, b, d, s)
            at = order[later]
            yield from marks(d[at], c[at], s[at], s[at] + WINDOW, buckets)

    return in_buckets(found).mapInArrow(tidied(work), ROW)


def with_blobs(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each bucket's blobs, then its documents, in one partition."""
    rows = docs.withColumn("kind", F.lit(None).cast("int")).withColumn("blob", F.lit(None).cast("binary"))
    both = rows.unionByName(blobs, allowMissingColumns=True)
    return even(both, "bucket", parts_of(docs.sparkSession)).sortWithinPartitions("bucket", F.desc_nulls_last("kind"))


class Held:
    """A bucket's packed rows by document, fed from the rows that precede the documents."""

    def __init__(self, kind: int, doc: int):
        self.kind, self.doc, self.bucket, self.blobs, self.columns = kind, doc, None, [], None

    def add(self, bucket: int, blob: bytes):
        if bucket != self.bucket:
            self.bucket, self.blobs = bucket, []
        self.blobs.append(blob)
        self.columns = None

    def of(self, bucket: int, doc: int, check: int) -> list[np.ndarray] | None:
        """Rows of one document, without its id and checksum."""
        if bucket != self.bucket:
            return None
        if self.columns is None:
            self.columns = unpack(self.kind, self.blobs)
            order = np.argsort(self.columns[self.doc], kind="stable")
            self.columns, self.blobs = [c[order] for c in self.columns], []
        ids = self.columns[self.doc]
        lo, hi = np.searchsorted(ids, doc), np.searchsorted(ids, doc, side="right")
        if lo == hi:
            return None
        own = np.flatnonzero(self.columns[self.doc + 1][lo:hi] == check) + lo
        return [c[own] for k, c in enumerate(self.columns) if k not in (self.doc, self.doc + 1)] if len(own) else None


def fetch_contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """Contexts of the requested places; equal ones of a task are settled, their earliest goes on."""

    def settle(held):
        h, d, c, at, ctx, left, right = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, d))
        h, d, c, at, ctx, left, right = (x[order] for x in (h, d, c, at, ctx, left, right))
        key = np.hstack([ctx, left[:, None], right[:, None]]).view(f"V{SPAN + 2}").ravel()
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        first = first[inverse.ravel()]
        later = (d != d[first]) | (at != at[first])
        most, least = np.minimum(left, LEFT).astype(np.int64), np.maximum(0, WINDOW - right.astype(np.int64))
        use = later & (least <= most)
        yield from marks(d[use], c[use], (at - most)[use], (at - least + WINDOW)[use], buckets)
        k = ~later
        yield from dealt(CONTEXTS, (h[k] % np.uint64(buckets)).astype(np.int32), [h[k], d[k], c[k], at[k], np.ascontiguousarray(ctx[k]).view(f"V{SPAN}").ravel(), left[k], right[k]])

    def work(batches):
        asked, held, size = Held(REQUESTS, 1), [], 0
        for b in batches:
            for bucket, kind, blob, doc, text in zip(*(b.column(c) for c in ("bucket", "kind", "blob", "_doc", "text"))):
                if kind.is_valid:
                    asked.add(bucket.as_py(), blob.as_py())
                    continue
                data = (text.as_py() or "").encode()
                got = len(data) >= WINDOW and asked.of(bucket.as_py(), doc.as_py(), zlib.crc32(data))
                if not got:
                    continue
                h, at = got
                for cut in range(0, len(at), HELD_CONTEXTS):
                    rows, left, right = contexts(data, at[cut : cut + HELD_CONTEXTS])
                    held.append((h[cut : cut + HELD_CONTEXTS], np.full(len(rows), doc.as_py()), np.full(len(rows), zlib.crc32(data), np.uint32), at[cut : cut + HELD_CONTEXTS], rows, left, right))
                    size += len(rows)
                    if size >= HELD_CONTEXTS:
                        yield from settle(held)
                        held, size = [], 0
        if held:
            yield from settle(held)

    return rows.select("bucket", "kind", "blob", "_doc", "text").mapInArrow(tidied(work), ROW)


class BlindTrie:
    """Patricia trie over equally long distinct strings: nodes hold only branching depths."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def common(self, a: bytes, b: bytes) -> int:
        return self.size - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8

    def add(self, s: bytes) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while isinstance(node, list):  # blindly down to some leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = self.common(s, node)
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = s
            return
        some = node
        while isinstance(some, list):
            some = next(iter(some[1].values()))
        new = [depth, {some[depth]: node, s[depth]: s}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def sorted(self) -> Iterator[tuple[bytes, int]]:
        """Strings in order, each with its common prefix with the one before."""
        stack, depth = [(self.root, 0)], 0
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                children = sorted(node[1].items())
                stack += [(child, node[0]) for _, child in children[:0:-1]]
                stack.append((children[0][1], depth))
            else:
                yield node, depth


def deep_shallow_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings, and each one's common prefix with the one before."""
    n, size = rows.shape
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return order, lcp
    # Shallow: split by eight bytes at a time; only what still ties is sorted on.
    tied = np.zeros(n, np.int64)  # the group of each place in the order; -1 once alone
    words = np.ascontiguousarray(rows[:, :SHALLOW]).view(">u8").astype(np.uint64)
    for level in range(words.shape[1]):
        at = np.flatnonzero(tied >= 0)
        if not len(at):
            break
        key = words[order[at], level]
        sub = np.lexsort((key, tied[at]))
        order[at], key = order[at][sub], key[sub]
        same_group = tied[at][1:] == tied[at][:-1]
        differ = key[1:] ^ key[:-1]
        leading = np.zeros(len(differ), np.int64)
        for byte in range(8):
            leading += (differ >> np.uint64(56 - 8 * byte)) == 0
        inner = at[1:][same_group & (differ != 0)]
        lcp[inner] = level * 8 + leading[same_group & (differ != 0)]
        begins = np.concatenate([[True], ~same_group | (differ != 0)])
        group = np.cumsum(begins) - 1
        alone = np.bincount(group)[group] == 1
        tied[at] = np.where(alone, -1, at[np.flatnonzero(begins)][group])
    # Deep: a blind trie for each group that ties down to the shallow depth.
    at = np.flatnonzero(tied >= 0)
    if len(at):
        for group in np.split(at, np.flatnonzero(np.diff(tied[at])) + 1):
            ids = order[group]
            same: dict[bytes, list[int]] = {}
            for i in ids.tolist():
                same.setdefault(rows[i].tobytes(), []).append(i)
            if len(same) == 1:
                lcp[group[1:]] = size
                continue
            trie = BlindTrie(size)
            for s in same:
                trie.add(s)
            new, common = [], []
            for s, depth in trie.sorted():
                new += same[s]
                common += [depth] + [size] * (len(same[s]) - 1)
            order[group], lcp[group[1:]] = new, common[1:]
    return order, lcp


def covered(h, doc, at, rows, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, start and end of what an earlier place covers round each anchor; rows in order of place."""
    n = len(h)
    right_rows, left_rows = rows[:, LEFT:], rows[:, :LEFT][:, ::-1]
    right_order, right_lcp = deep_shallow_sort(np.ascontiguousarray(right_rows))
    left_order, left_lcp = deep_shallow_sort(np.ascontiguousarray(left_rows))
    hit = np.zeros((n, LEFT + 3), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(LEFT + 1):  # windows that begin a bytes before the anchor
        right_class[right_order] = np.cumsum(right_lcp < WINDOW - a)
        left_class[left_order] = np.cumsum(left_lcp < a)
        ok = np.flatnonzero((left >= a) & (right >= WINDOW - a))
        _, first, inverse = np.unique(right_class[ok] * (n + 1) + left_class[ok], return_index=True, return_inverse=True)
        first = ok[first[inverse.ravel()]]
        hit[ok, a + 1] = (doc[ok] != doc[first]) | (at[ok] != at[first])
    edge = np.diff(hit.astype(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return i, at[i] - (high - 1), at[i] - low + WINDOW


def compare_contexts(found: DataFrame, buckets: int) -> DataFrame:
    """Marks from the contexts of each hash; marks that come along go on."""

    def compare(blobs):
        h, d, c, at, ctx, left, right = unpack(CONTEXTS, blobs)
        order = np.lexsort((at, d, h))
        h = h[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
        first = 0
        while first < len(cuts) - 1 and len(h):  # whole groups, some HELD_CONTEXTS rows at a time
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + HELD_CONTEXTS)) - 1)
            o = order[cuts[first] : cuts[last]]
            o = o[np.lexsort((at[o], d[o]))]
            first = last
            rows = np.frombuffer(ctx[o].tobytes(), np.uint8).reshape(len(o), SPAN)
            i, start, end = covered(h, d[o], at[o], rows, left[o], right[o]) if len(o) > 1 else ([], [], [])
            if len(i):
                yield from marks(d[o][i], c[o][i], start, end, buckets)

    def work(batches):
        for blobs in by_kind(batches):
            for blob in blobs[MARKS]:
                yield from marks(*unpack(MARKS, [blob]), buckets)
            yield from compare(blobs.pop(CONTEXTS))

    return in_buckets(found).mapInArrow(tidied(work), ROW)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def widened(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of UTF-8 text, each widened to the borders of the characters that it cuts in part."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for s, e in spans:
        while inside(s):
            s -= 1
        while inside(e):
            e += 1
        out.append((s, e))
    return merged(*np.array(out, np.int64).T) if out else out


def dedupe(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs with ``_kept``, ``_removed`` and ``_spans`` of cut_rows(), which replace columns of these names."""
    others = [c for c in docs.columns if c.lower() not in ("_kept", "_removed", "_spans")]
    return cut_rows(docs, whole).select(*[F.col(f"_row.`{c}`").alias(c) for c in others], "_kept", "_removed", "_spans")


def cut_rows(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(_row, _kept, _removed, _spans): each row of docs, its remaining bytes, how many were cut, in how many maximal runs; with whole, characters cut in part go whole."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts_of(spark), math.ceil(size / BUCKET_BYTES))
    own = docs.select(nested(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc"), "text")
    own = own.withColumn("bucket", doc_bucket_column(buckets))
    small = own.select("_doc", "text", "bucket")
    first = written(repeated(find_anchors(small, hot_anchors(small), buckets), buckets), "anchors")
    asked = fetch_contexts(with_blobs(small, first.where(F.col("kind") == REQUESTS)), buckets)
    second = written(compare_contexts(asked, buckets), "marks")
    every = first.where(F.col("kind") == MARKS).unionByName(second)
    rows = with_blobs(own.drop("text"), every)
    result_type = own.select("_row").schema.add("_kept", "binary").add("_removed", "long").add("_spans", "long")
    schema = pa.schema([("_kept", pa.binary()), ("_removed", pa.int64()), ("_spans", pa.int64())])

    def cut(batches):
        held = Held(MARKS, 0)
        for b in batches:
            use, out = [], []
            texts = b.column("_row").field("text")
            for i, (bucket, kind, blob, doc) in enumerate(zip(*(b.column(c) for c in ("bucket", "kind", "blob", "_doc")))):
                if kind.is_valid:
                    held.add(bucket.as_py(), blob.as_py())
                    continue
                data = (texts[i].as_py() or "").encode()
                got = held.of(bucket.as_py(), doc.as_py(), zlib.crc32(data))
                spans = merged(*got) if got else []
                spans = widened(data, spans) if whole else spans
                kept = b"".join(data[e:s] for e, s in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(data)]))
                use.append(i)
                out.append((kept, len(data) - len(kept), len(spans)))
            if use:
                row = b.column("_row").take(pa.array(use))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays([row, *columns], names=["_row", "_kept", "_removed", "_spans"])

    return rows.select("bucket", "kind", "blob", "_doc", "_row").mapInArrow(tidied(cut), result_type)


def op5(docs: DataFrame) -> DataFrame:
    """The digest of dedupe()."""
    found = dedupe(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length("_kept") + F.col("_removed")).cast("long").alias("n_bytes"),
        F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


def oracle() -> str:
    """The rows of op5() as DuckDB SQL: every window of every text, compared by its bytes' checksum."""
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * WINDOW})) AS x
        FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {WINDOW - 1})) AS p FROM d WHERE length(h) >= {2 * WINDOW})),
    f AS (SELECT x, min((doc_id, p)) AS first FROM w GROUP BY x HAVING count(*) > 1),
    v AS (SELECT doc_id, p FROM w JOIN f USING (x) WHERE (doc_id, p) > first),
    stepped AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM v),
    runs AS (SELECT doc_id, min(p) AS s, max(p) + {WINDOW} AS e
        FROM (SELECT doc_id, p, sum(CASE WHEN p <= before + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM stepped) GROUP BY doc_id, run),
    g AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e FROM runs GROUP BY doc_id),
    k AS (SELECT d.doc_id, h, n_spans, n_removed, CASE WHEN g.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(len(s) + 1),
        lambda i: substr(h, 2 * coalesce(e[i], 0) + 1, 2 * (coalesce(s[i + 1], length(h) // 2) - coalesce(e[i], 0)))), '') END AS kept FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k"""
