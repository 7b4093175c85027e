"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two documents link when |A & B| >= share * |A | B|. Small (light) sets are joined by
enumerating fixed-size subsets: sets of sizes a <= b link just when they share a subset of
c(a, b) shingles, so each emits its subsets of that size and equal subsets meet. Large
(heavy) sets meet in inverted lists of their rarest shingles, as many as every partner
must hit one of. The boundary between both is the size at which the sum of subsets and
list entries over the measured histogram of sizes costs least; light sets large enough
for a heavy partner are in the lists as well.

A list of more than LONG_LIST members is keyed anew by a second shingle of each (partners
share two of their rarest), and what is still longer is dealt into blocks; members go on
together only where bitmaps of their whole sets leave a link possible. The order "rarest
first" comes from counters, more of them for larger inputs; any order gives the same links.

What met forms candidate groups, each of which is verified exactly by scanning inverted
lists of its whole sets; a group of more than BLOCK shingles is dealt by size and hash
into blocks and verified in pairs of blocks whose sizes can link. Equal sets are one class
before all that and get its result, so copies cost nothing.

A null or blank text is an empty set: no shingle, no link. Rows that share a doc_id are
one node; a null doc_id is never linked and has a null component.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, row_parts, tidied, written
from .graph import components

#: Counters that stand for the frequency of shingles, as powers of two: one for so many bytes of text, from the least to the most
#: (a broadcast of 32 MB); summed in so many parts.
COUNTER_BYTES, LEAST_BITS, MOST_BITS, COUNTER_PARTS = 128, 20, 25, 64
#: Bits of a set's bitmap, at most.
LARGEST_BITMAP = 1 << 14
#: Members of a list that are compared by their bitmaps in one task; longer lists are split.
LONG_LIST = 4096
#: Shingles of one block of a candidate group.
BLOCK = 1_500_000
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20
#: Classes of copies that can each be more than one row in so many.
HOT_CLASSES = 1000
#: Sizes for which enumeration is weighed at all; beyond, subsets grow too fast.
LARGEST_LIGHT = 24
#: Cost of a list entry in units of a subset: it is sorted, and its group verified.
ENTRY_COST = 4.0
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: ASCII blanks: between words.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK = np.isin(np.arange(256), list(BLANKS))
#: A random number for each byte, the same for a letter's two cases.
TABLE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
TABLE[ord("A") : ord("Z") + 1] = TABLE[ord("a") : ord("z") + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the powers 0 to n - 1, and those of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), x, np.uint64))]) for x in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it begins: a polynomial in its bytes, ASCII letters lower-cased, read off one running sum."""
    held, begins, at = [], [], 0
    up, down = powers(min(len(data) + 1, PIECE + 1))
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):  # not inside a word, unless it is longer than a piece
            cut = max(data.rfind(c, at, stop) for c in BLANKS)
            stop = cut + 1 if cut > at else next((j for j in range(stop, len(data)) if data[j] in BLANKS), len(data))
        if stop - at >= len(up):
            up, down = powers(stop - at + 1)
        piece = np.frombuffer(data, np.uint8, stop - at, at)
        blank = BLANK[piece]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[piece] * up[: len(piece)])])
        held.append((total[last] - total[first]) * down[first])
        begins.append(first + at)
        at = stop
    return (np.concatenate(held), np.concatenate(begins)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of words; of all its words if they are fewer."""
    data = [(t or "").encode() for t in texts]
    h, at = word_hashes(b" ".join(data))
    sizes = np.array([len(d) + 1 for d in data])
    count = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))
    ends = np.cumsum(count)

    def runs(h: np.ndarray, span: int) -> np.ndarray:
        out = np.zeros(len(h) - span + 1, np.uint64)
        for k in range(span):
            out = mixed(out) + h[k : len(h) - span + 1 + k]
        return mixed(out + np.uint64(span))

    whole = runs(h, words) if len(h) >= words else None
    return [np.unique(whole[e - n : e - words + 1] if n >= words else runs(h[e - n : e], n)) if n else np.zeros(0, np.uint64) for e, n in zip(ends.tolist(), count.tolist())]


def overlap_needed(a: int, b: int, share: tuple[int, int]) -> int:
    """Least |A & B| at which sets of these sizes link; share is a fraction (p, q)."""
    return -(-share[0] * (a + b) // (share[0] + share[1]))


def partners(n: int, share: tuple[int, int]) -> range:
    """Sizes of at least n that can link with n."""
    return range(n, n * share[1] // share[0] + 1)


def smaller(n: int, share: tuple[int, int]) -> range:
    return range(-(-n * share[0] // share[1]), n)


def prefix_length(n: int, share: tuple[int, int]) -> int:
    """So many of its rarest shingles a set shares at least one with every partner."""
    return n - -(-n * share[0] // share[1]) + 1 if n else 0


def subset_count(n: int, share: tuple[int, int]) -> int:
    pairs = [(n, b) for b in partners(n, share)] + [(a, n) for a in smaller(n, share)]
    return sum(math.comb(n, overlap_needed(a, b, share)) for a, b in pairs)


def boundary(histogram: dict[int, int], share: tuple[int, int]) -> int:
    """The largest light size at which enumerating and scanning cost least together."""
    best, at = math.inf, 0
    for x in range(LARGEST_LIGHT + 1):
        listed = -(-(x + 1) * share[0] // share[1])  # light sets from this size on also have heavy partners
        cost = sum(k * subset_count(n, share) for n, k in histogram.items() if 0 < n <= x)
        cost += ENTRY_COST * sum(k * prefix_length(n, share) for n, k in histogram.items() if n >= listed)
        if cost < best:
            best, at = cost, x
    return at


def subsets(s: np.ndarray, share: tuple[int, int], light: int) -> Iterator[tuple[int, int]]:
    """(key, 1 for the smaller size of the pair it is for, else 0) of each subset a light set emits."""
    n = len(s)
    for a, b in [(n, b) for b in partners(n, share) if b <= light] + [(a, n) for a in smaller(n, share)]:
        c = overlap_needed(a, b, share)
        for chosen in combinations(s.tolist(), c):
            key = xxhash.xxh64_intdigest(np.array([a, b, *chosen], np.uint64).tobytes())
            yield key, int(n == a)


def counters(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles fall on each counter, over all documents, as eight times the logarithm to base 2."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // COUNTER_BYTES).bit_length()))
    part = (1 << bits) // COUNTER_PARTS
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def packed(n: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(n.tobytes())

    def unpacked(blob: bytes, kind) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for b in row_parts(batches, "text", PIECE):
            np.add.at(total, counter_of(np.concatenate(shingles_of(b.column("text").to_pylist(), words)), bits), np.uint32(1))
        for k in range(COUNTER_PARTS):
            own = total[k * part : (k + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(own)], pa.binary())], schema=schema)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
                total.setdefault(k, np.zeros(part, np.uint64))[:] += unpacked(blob, np.uint32)
        for k, n in total.items():
            scaled = np.minimum(255, np.round(8 * np.log2(1.0 + n))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(scaled)], pa.binary())], schema=schema)

    rows = docs.select("text").mapInArrow(tidied(count), "part int, blob binary").repartition(COUNTER_PARTS, "part")
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.mapInArrow(tidied(add), "part int, blob binary").collect():  # COUNTER_PARTS rows
        out[r["part"] * part : (r["part"] + 1) * part] = unpacked(r["blob"], np.uint8)
    return out


def counter_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap in which a shingle flips one bit: two of them differ in at most as many bits as their sets do in shingles."""
    n = min(LARGEST_BITMAP, max(256, 1 << max(0, len(s) // 2 - 1).bit_length()))
    return np.packbits((np.bincount((s % np.uint64(n)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def set_table(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, sig, prefix, bits) of each row: sig names its set; prefix has its rarest shingles, one more than lists take, all of a small set."""
    order = docs.sparkSession.sparkContext.broadcast(counters(docs, words))  # 1 << MOST_BITS bytes at most
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("prefix", pa.binary()), ("bits", pa.binary())])

    def sets(batches):
        n = order.value
        bits = len(n).bit_length() - 1
        for b in row_parts(batches, "text", PIECE):
            out = []
            for i, s in zip(b.column("doc_id").to_pylist(), shingles_of(b.column("text").to_pylist(), words)):
                kept = len(s) if len(s) <= LARGEST_LIGHT else prefix_length(len(s), share) + 1
                rarest = s[np.lexsort((s, n[counter_of(s, bits)]))[:kept]]
                out.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, rarest.tobytes(), parity_bits(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(sets), "doc_id long, n_shingles long, sig binary, prefix binary, bits binary")


def met(reps: DataFrame, share: tuple[int, int], light: int) -> DataFrame:
    """Edges (a, b) between sets that share a subset, or a list entry and may link, as stars."""
    listed = -(-(light + 1) * share[0] // share[1])
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64())])

    def emit(batches):
        for b in batches:
            key, kind, size, doc = [], [], [], []
            for i, n, p in zip(b.column("doc_id").to_pylist(), b.column("n_shingles").to_pylist(), b.column("prefix").to_pylist()):
                s, m = np.frombuffer(p, np.uint64), 0
                if n >= listed:
                    own = s[: prefix_length(n, share)]
                    key.append(own)
                    kind.append(np.zeros(len(own), np.int32))
                    m += len(own)
                if n <= light:
                    got = list(subsets(np.sort(s), share, light))
                    key.append(np.array([k for k, _ in got], np.uint64))
                    kind.append(np.array([2 - small for _, small in got], np.int32))
                    m += len(got)
                size.append(np.full(m, n))
                doc.append(np.full(m, i))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(kind).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int64)), pa.array(np.concatenate(doc).astype(np.int64))], schema=schema)

    found = written(runs_of(reps.select("doc_id", "n_shingles", "prefix").mapInArrow(tidied(emit), ENTRY), share), "runs")
    lists = found.where("kind = 0").select("key", "centre", "doc_id")
    long = found.where((F.col("kind") == 0) & (F.col("rank") == LONG_LIST)).select("key", "centre")
    if long.limit(1).count():
        members = written(lists.join(long, ["key", "centre"], "left_semi"), "long")
        lists = lists.join(long, ["key", "centre"], "left_anti")
        if 2 * share[0] > share[1]:  # partners that are not equal share two shingles
            entries = members.join(reps.select("doc_id", "n_shingles", "prefix"), "doc_id").mapInArrow(tidied(lambda batches: seconds(batches, share)), ENTRY)
            members = written(runs_of(entries, share).select("key", "centre", "doc_id"), "seconds")
        size = F.ceil(F.col("size") / LONG_LIST).cast("int")
        sized = members.join(members.groupBy("key", "centre").agg(F.count("*").alias("size")), ["key", "centre"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), size).cast("int"))
        sides = sized.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("other"))
        blocks = sides.select("key", "centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id")
    else:
        blocks = None
    lists = lists.select("key", "centre", F.lit(0).alias("low"), F.lit(0).alias("high"), "doc_id")
    lists = (lists if blocks is None else lists.unionByName(blocks)).join(reps.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "bits"), "sig").alias("s")), "doc_id")
    group = ["key", "centre", "low", "high"]
    possible = (
        lists.select(*group, "doc_id", F.col("s.n_shingles").alias("n"), F.col("s.bits").alias("bits"))
        .repartition(*group).sortWithinPartitions(*group, "doc_id").mapInArrow(tidied(lambda batches: neighbours(batches, share)), "a long, b long")
    )
    return possible.unionByName(found.where("kind > 0").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))).where("a <> b")


ENTRY = "key long, kind int, n long, doc_id long"


def seconds(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of members (key, doc_id, n_shingles, prefix) of long lists: entries for the key with each later shingle of the prefix that partners may share next."""
    for b in batches:
        key, size, doc = [], [], []
        for k, i, n, p in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "n_shingles", "prefix"))):
            s = np.frombuffer(p, np.uint64)[: prefix_length(n, share) + 1]
            first = np.array([k], np.int64).view(np.uint64)
            later = s[int(np.flatnonzero(s == first)[0]) + 1 :]
            key.append(mixed(mixed(np.repeat(first, len(later))) + later))
            size.append(np.full(len(later), n))
            doc.append(np.full(len(later), i))
        if key:
            k = np.concatenate(key).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.zeros(len(k), np.int32)), pa.array(np.concatenate(size).astype(np.int64)), pa.array(np.concatenate(doc).astype(np.int64))], names=["key", "kind", "n", "doc_id"])


def runs_of(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Rows (key, kind, centre, doc_id, rank) of runs of two or more entries of one key, subset or list, in order of size.

    A run ends at a gap of sizes that no link spans. Its first member is the centre; rank counts from it.
    """

    def runs(batches):
        last = (None, None, None, None, None, False)  # key, list, size, centre, rank, whether it began a run
        for b in batches:
            k, t, n, d = (b.column(c).to_numpy() for c in ("key", "kind", "n", "doc_id"))
            if not len(k):
                continue
            t = (t > 0).astype(np.int64)
            begins = np.ones(len(k), bool)
            begins[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (n[:-1] * share[1] < n[1:] * share[0])
            if last[0] is not None:
                begins[0] = not (k[0] == last[0] and t[0] == last[1] and last[2] * share[1] >= n[0] * share[0])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(k)), -1))
            goes_on = at < 0
            centre = np.where(goes_on, last[3] if last[3] is not None else -1, d[np.maximum(at, 0)])
            rank = np.where(goes_on, np.arange(len(k)) + 1 + (last[4] or 0), np.arange(len(k)) - at)
            second = ~begins & np.concatenate([[last[5]], begins[:-1]])
            last = (k[-1], t[-1], n[-1], centre[-1], int(rank[-1]), bool(begins[-1]))
            use = ~begins
            columns = ((k, k), (t, t), (centre, centre), (d, centre), (rank, np.zeros(len(k), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[use], y[second]])) for x, y in columns], names=["key", "kind", "centre", "doc_id", "rank"])

    ordered = entries.repartition("key").sortWithinPartitions("key", F.col("kind") > 0, "n", "doc_id")
    return ordered.mapInArrow(tidied(runs), "key long, kind long, centre long, doc_id long, rank long")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: halves laid over each other flip alike."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def neighbours(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Lists (key, centre, low, high), in order, into stars of the members that their bitmaps connect."""

    def stars(docs, sizes, bitmaps):
        docs, sizes = np.array(docs), np.array(sizes)
        words = np.array([len(x) // 8 for x in bitmaps])
        held = {w: np.frombuffer(b"".join(x for x, v in zip(bitmaps, words) if v == w), np.uint64).reshape(-1, w) for w in np.unique(words).tolist()}
        row = np.zeros(len(docs), np.int64)
        for w in held:
            row[words == w] = np.arange((words == w).sum())
        left, a, b = np.arange(len(docs)), [], []
        while len(left):
            centre, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                i = front.pop()
                most = sizes[i] + sizes[left] - 2 * -(-share[0] * (sizes[i] + sizes[left]) // (share[0] + share[1]))
                near = (np.minimum(sizes[i], sizes[left]) * share[1] >= np.maximum(sizes[i], sizes[left]) * share[0]).astype(bool)
                for w in held:
                    at = np.flatnonzero(near & (words[left] == w))
                    if len(at):
                        both = min(w, words[i])
                        differ = np.bitwise_count(folded(held[w][row[left[at]]], both) ^ folded(held[int(words[i])][row[i]], both)).sum(1, dtype=np.int64)
                        near[at] = differ <= most[at]
                front += left[near].tolist()
                a += docs[left[near]].tolist()
                b += [docs[centre]] * int(near.sum())
                left = left[~near]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key, held = None, ([], [], [])
    for batch in batches:
        for *group, d, n, bits in zip(*(batch.column(x).to_pylist() for x in ("key", "centre", "low", "high", "doc_id", "n", "bits"))):
            if group != key:
                if len(held[0]) > 1:
                    yield stars(*held)
                key, held = group, ([], [], [])
            for x, y in zip(held, (d, n, bits)):
                x.append(y)
    if len(held[0]) > 1:
        yield stars(*held)


def linked(sets: list[np.ndarray], own: np.ndarray, copies: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the index of one it hangs together with, the same for all of them, and how many rows it links with, found by scanning
    inverted lists. own: 0 or 1 for each set's block; with two blocks only links across count. copies: rows that each set stands for."""
    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    posting, ends = owner[order], np.cumsum(np.bincount(token))
    starts = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(size)])
    two = bool(own.any() and not own.all())
    label, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        if two and own[i]:
            continue
        lists = [posting[starts[t] : ends[t]] for t in token[at[i] : at[i + 1]]]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets))
        ok = shared * (share[0] + share[1]) >= share[0] * (size + size[i])
        ok &= own == 1 if two else np.arange(len(sets)) > i
        hit = np.flatnonzero(ok)
        if len(hit):
            links[i] += copies[hit].sum()
            links[hit] += copies[i]
            joined = np.unique(np.append(label[hit], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return label, links


def verified(grouped: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Rows (grp, low, high, side, doc_id, copies, text), sorted by group in each partition, into rows (a, b, n): a hangs together with b and links with n rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def flush(group):
        ids = np.array([g[0] for g in group], np.int64)
        label, links = linked(shingles_of([g[3] for g in group], words), np.array([g[1] for g in group]), np.array([g[2] for g in group]), share)
        low = np.full(len(ids), 2**63 - 1)
        np.minimum.at(low, label, ids)
        use = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(low[label][use]), pa.array(links[use])], schema=schema)

    def verify(batches):
        group, key = [], None
        for b in batches:
            for g, low, high, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "low", "high", "doc_id", "side", "copies", "text"))):
                if (g, low, high) != key:
                    if len(group) > 1:
                        yield flush(group)
                    group, key = [], (g, low, high)
                group.append(row)
        if len(group) > 1:
            yield flush(group)

    return grouped.mapInArrow(tidied(verify), "a long, b long, n long")


def join(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of documents (doc_id, text); n_links counts rows, copies among them."""
    rows = written(set_table(docs, words, share), "sets")
    known = rows.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), F.col("sig").alias("own"), "copies"), "doc_id").where("sig = own").drop("own")
    reps = reps.dropDuplicates(["doc_id", "sig"])
    histogram = {r["n_shingles"]: r["count"] for r in reps.where(F.col("n_shingles") <= 2 * LARGEST_LIGHT).groupBy("n_shingles").count().collect()}
    light = boundary(histogram, share)
    groups = written(components(met(reps, share, light)).withColumnRenamed("id", "doc_id"), "groups")

    # Groups beyond BLOCK shingles in blocks: by classes of size, of which only neighbours can link, and by hash; most groups have one.
    sized = written(groups.join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.max("copies").alias("copies")), "doc_id"), "sized")
    classed = sized.withColumn("class", F.floor(F.log(F.col("n")) / math.log(share[1] / share[0]) + 1e-9).cast("int") if share[0] < share[1] else F.col("n").cast("int"))
    totals = classed.groupBy("component", "class").agg(F.sum("n").alias("held"))
    whole = totals.groupBy("component").agg(F.sum("held").alias("total")).where(F.col("total") > BLOCK)
    several = whole.limit(1).count() > 0
    if several:
        large = written(whole, "large")
        dealt = classed.join(large, "component").join(totals, ["component", "class"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("held") / BLOCK)).cast("int"))
        placed = dealt.select("doc_id", "component", "n", "copies", "class", "part")
        rest = classed.join(large, "component", "left_anti").select("doc_id", "component", "n", "copies", F.lit(0).alias("class"), F.lit(0).alias("part"))
        blocks = written(placed.unionByName(rest).withColumn("block", F.col("class").cast("long") * (1 << 31) + F.col("part")), "blocks")
    else:
        blocks = sized.withColumn("block", F.lit(0).cast("long"))
    spans = blocks.groupBy("component", "block").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"))
    other = spans.select("component", F.col("block").alias("with"), F.col("low_n").alias("l2"), F.col("high_n").alias("h2"))
    can_link = (F.col("high_n") * share[1] >= F.col("l2") * share[0]) & (F.col("h2") * share[1] >= F.col("low_n") * share[0])
    met_blocks = spans.join(other, "component").where((F.col("with") >= F.col("block")) & can_link)
    pairs = met_blocks.select("component", F.explode(F.array(
        F.struct(F.col("block").alias("block"), F.col("block").alias("low"), F.col("with").alias("high"), F.lit(0).alias("side")),
        F.struct(F.col("with").alias("block"), F.col("block").alias("low"), F.col("with").alias("high"), F.lit(1).alias("side")),
    )).alias("p")).select("component", "p.*").where("side = 0 OR low <> high")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(blocks.select("doc_id", "component", "block", "copies"), "doc_id")
    grouped = (
        texts.join(pairs, ["component", "block"]).withColumnRenamed("component", "grp")
        .repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "side", "doc_id")
        .select("grp", "low", "high", "side", "doc_id", "copies", "text")
    )
    found = written(verified(grouped, words, share), "links")
    label = components(found) if several else found.select(F.col("a").alias("id"), F.col("b").alias("component"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = (
        classes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
        .select(F.col("sig").alias("_sig"), "copies", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    # The rows of a class of copies that is a large share of all find its result in a broadcast; there are HOT_CLASSES of those at most.
    least = known.count() // HOT_CLASSES + 1
    large = rows.join(F.broadcast(named.where(F.col("copies") >= least)), F.col("sig") == F.col("_sig"), "left")
    others = large.where("_sig IS NULL").select("doc_id", "n_shingles", "sig").join(named.where(F.col("copies") < least), F.col("sig") == F.col("_sig"), "left")
    known_id = F.col("doc_id").isNotNull()
    return large.where("_sig IS NOT NULL").select("doc_id", "n_shingles", "component_id", "n_links").unionByName(others.select("doc_id", "n_shingles", "component_id", "n_links")).select(
        "doc_id", "n_shingles", F.when(known_id, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known_id, F.coalesce("n_links", F.lit(0))).alias("n_links")
    )


def op2(docs: DataFrame) -> DataFrame:
    """The digest of join(): four words, 85 of 100."""
    return join(docs, 4, (85, 100))


def oracle() -> str:
    """The rows of op2() as DuckDB SQL: every two different sets that share a shingle are compared."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')))) END AS s FROM d),
    c AS MATERIALIZED (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
    e AS MATERIALIZED (SELECT rep, n, copies, unnest(s) AS x FROM c),
    links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, b.copies FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
        GROUP BY a.rep, a.n, b.rep, b.n, b.copies HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
    linked AS (SELECT a AS rep, sum(copies) AS n FROM links GROUP BY a),
    near AS (SELECT c.s, low.component_id, c.copies - 1 + coalesce(linked.n, 0) AS n_links FROM c JOIN low ON c.rep = low.rep LEFT JOIN linked ON c.rep = linked.rep)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(near.component_id, s.doc_id) AS component_id, CAST(coalesce(near.n_links, 0) AS BIGINT) AS n_links
    FROM s LEFT JOIN near ON s.s = near.s"""


def representatives(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without those that another of smaller id stands for; a row without id always stays.

    Of rows of one id and equal texts one stays, the first by a hash of all its columns; rows of one
    id and different texts all stay where their id does.
    """
    found = written(join(docs, words, share), "joined")
    stay = found.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_stays")).distinct()
    own = docs.select(nested(docs), F.col("doc_id").cast("long").alias("_id"), "text")
    kept = own.join(stay, F.col("_id").eqNullSafe(F.col("_stays")), "left_semi")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = F.min_by("_row", F.sha2(F.to_json("_row", {"ignoreNullFields": "false"}), 256)).alias("_row")
        once = kept.where("_id IS NOT NULL").groupBy("_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()).agg(first)
        kept = once.select("_row").unionByName(kept.where("_id IS NULL").select("_row"))
    return kept.select("_row.*")
