"""Document fingerprints by randomised edit embedding.

All documents share one random walk: at step j with the reader on a character of class c
the embedding puts out c, and the reader moves on if the shared bit r(j, c) is 1. Two
texts that differ by few edits fall into step again after each edit, so their edit
distance shows as Hamming distance between embeddings. A fingerprint samples bits of the
embedding: every position below 64, then SAMPLES in each range [2^L, 2^(L+1)), up to the
embedding's own end; the end itself stands in front. Likeness weighs each sampled bit by
the steps it stands for, takes half of what only one text has as different, and is
1 - 2 * share of differing bits, at least 0.

Whole texts are walked, however long. A null text is an empty one; two empty texts are
alike (1.0), an empty and another are not (0.0). Equal texts have equal fingerprints.
The next document is the one with the next smaller doc_id (null is smallest; equal ids
follow each other by a hash of the text), after the last comes the first.

Near documents are found by bands of sampled bits: equal fingerprints are one class, two
classes meet where all bits of a band are the same, and what met is verified by likeness.
A band has more bits the more classes there are, so that buckets stay small, and there are
as many bands as a pair at the bound needs to meet with the chance RECALL. Documents
without an id take no part.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even, parts_of, row_parts, tidied, written
from .graph import components, roots

SAMPLES, LEVELS, SEED = 64, 40, 8
CLASSES, PERIOD = 256, 4096
#: Below so many texts in step, texts are walked one at a time.
WIDE = 96
PART_BYTES = 8 << 20
#: Text of one range of ids, about.
BUCKET_BYTES = 256 << 20
#: Classes of a bucket that are compared with as many others at a time.
BLOCK = 512
#: Classes of a bucket that are connected with as many others at a time.
STARS = 4096
#: Chance that a pair of just the likeness asked for meets in some band.
RECALL = 0.95
#: Bits of a band beyond the logarithm of the number of classes: a class then meets one that is not near in few of its buckets.
SPARE_BITS = 3


class Walk:
    """The shared randomness: step lengths, sampled positions, their weights and bits."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        moves[:, -1] = 1
        after = np.where(np.hstack([moves, moves]) == 1, np.arange(2 * PERIOD), 2 * PERIOD)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        self.jump = (after - np.arange(PERIOD) + 1).astype(np.uint16)
        self.flat = self.jump.ravel().astype(np.int64)
        self.rows = [list(map(int, r)) for r in self.jump]
        at, weight = [np.arange(64)], [np.ones(64)]
        for level in range(6, LEVELS):
            at.append(np.sort(rng.integers(1 << level, 2 << level, SAMPLES)))
            weight.append(np.full(SAMPLES, 2.0**level / SAMPLES))
        self.at, self.weight = np.concatenate(at), np.concatenate(weight)
        self.sums = np.concatenate([[0.0], np.cumsum(self.weight)])
        self.bits = rng.integers(0, 2, (len(self.at), CLASSES), dtype=np.uint8)

    def ends(self, parts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
        """For each text's classes the step after each character, from the step begin."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        out = [np.empty(len(p), np.int64) for p in parts]
        size = np.array([len(parts[i]) for i in order])
        done = 0
        if len(order) >= WIDE and (done := int(size[WIDE - 1])):
            flat = np.concatenate([parts[i] for i in order]).astype(np.int64) * PERIOD
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            steps = np.empty(len(flat), np.int64)
            j = np.array([begin[i] for i in order], np.int64)
            active = np.searchsorted(-size, -np.arange(done), side="left")
            for i in range(done):
                k = active[i]
                j, at = j[:k], start[:k] + i
                j = j + self.flat[flat[at] + (j & (PERIOD - 1))]
                steps[at] = j
            for n, i in enumerate(order):
                out[i][: min(done, size[n])] = steps[start[n] : start[n] + min(done, size[n])]
        table, mask = self.rows, PERIOD - 1
        for i in order:
            if len(parts[i]) <= done:
                break
            j = int(out[i][done - 1]) if done else begin[i]
            out[i][done:] = [j := j + table[c][j & mask] for c in parts[i][done:].tolist()]
        return out

    def fingerprint(self, classes: np.ndarray, ends: np.ndarray) -> str:
        end = int(ends[-1]) if len(ends) else 0
        n = int(np.searchsorted(self.at, end))
        which = classes[np.searchsorted(ends, self.at[:n], side="right")] if n else np.zeros(0, np.uint8)
        return f"{end:x}:{np.packbits(self.bits[np.arange(n), which]).tobytes().hex()}"

    def likeness(self, a: str, b: str) -> float:
        (end_a, bits_a), (end_b, bits_b) = a.split(":"), b.split(":")
        both = sorted((int(end_a, 16), int(end_b, 16)))
        n, m = np.searchsorted(self.at, both)
        if m == 0:
            return float(a == b)
        x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8))[:n] for s in (bits_a, bits_b))
        differ = float(self.weight[:n][x != y].sum()) + (self.sums[m] - self.sums[n]) / 2
        return max(0.0, 1 - 2 * differ / float(self.sums[m]))

    def windows(self, n: int, least: float) -> list[tuple[int, int, int]]:
        """(level, first sample, samples) from which keys of a text of n samples are drawn.

        Its own level, and each lower one whose longest texts can still have a likeness of
        least: two texts meet at the level of the shorter one. Levels begin at every power of
        two up to 64 samples and at each range of SAMPLES from there; a window is the whole
        ranges below that, two at most.
        """
        begin = [1 << k for k in range(6)] + list(range(64, len(self.at) + 1, SAMPLES))
        own = bisect.bisect_right(begin, n) - 1
        return [
            (k, low := max(0, begin[k] - 2 * SAMPLES), begin[k] - low)
            for k in range(own, -1, -1) if k == own or self.sums[begin[k + 1] - 1] >= least * self.sums[n]
        ]

    def hanging(self, prints: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Stars (index, centre's index) that connect what links of likeness least or more connect.

        Of a tight group the first member finds nearly all the others, so it costs one row of comparisons.
        """
        n = np.searchsorted(self.at, [int(p.split(":")[0], 16) for p in prints])
        bits = np.zeros((len(prints), int(n.max(initial=0))), np.uint8)
        for row, k, p in zip(bits, n, prints):
            row[:k] = np.unpackbits(np.frombuffer(bytes.fromhex(p.split(":")[1]), np.uint8))[:k]
        left, a, b = np.arange(len(prints)), [], []
        while len(left) > 1:
            centre, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                i = front.pop()
                m = n[i]
                differ = ((bits[left, :m] != bits[i, :m]) & (np.arange(m) < n[left, None])) @ self.weight[:m]
                less, more = self.sums[np.minimum(m, n[left])], self.sums[np.maximum(m, n[left])]
                near = (1 - 2 * (differ + (more - less) / 2) / np.maximum(more, 1) >= least) | (more == 0)
                front += left[near].tolist()
                a.append(left[near])
                b.append(np.full(int(near.sum()), centre))
                left = left[~near]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def likenesses(self, a: list[str], b: list[str]) -> np.ndarray:
        """likeness() of each of a and each of b. Weights are whole numbers, so the sums are exact in any order."""

        def read(prints):
            split = [p.split(":") for p in prints]
            n = np.searchsorted(self.at, [int(end, 16) for end, _ in split])
            bits = np.zeros((len(prints), width := int(n.max(initial=0))))
            for row, k, (_, held) in zip(bits, n, split):
                row[:k] = np.unpackbits(np.frombuffer(bytes.fromhex(held), np.uint8))[:k]
            return n, bits, (np.arange(width) < n[:, None]).astype(float)

        (n, x, has_x), (m, y, has_y) = read(a), read(b)
        width = min(x.shape[1], y.shape[1])
        x, has_x, y, has_y = x[:, :width], has_x[:, :width], y[:, :width], has_y[:, :width]
        w = self.weight[:width]
        differ = np.hstack([x * w, has_x, x * (-2 * w)]) @ np.hstack([has_y, y * w, y]).T
        less, more = self.sums[np.minimum.outer(n, m)], self.sums[np.maximum.outer(n, m)]
        near = np.maximum(0.0, 1 - 2 * (differ + (more - less) / 2) / np.maximum(more, 1))
        return np.where(more == 0, 1.0, near)


def classes_of(text: str) -> np.ndarray:
    """A class from 0 to 255 for each code point; ASCII characters have classes of their own."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, 128 + ((points * np.uint32(2654435761)) >> np.uint32(25))).astype(np.uint8)


def fingerprints(texts: list[str], walk: Walk) -> list[str]:
    classes = [classes_of(t) for t in texts]
    return [walk.fingerprint(c, e) for c, e in zip(classes, walk.ends(classes, [0] * len(texts)))]


def edited(text: str, following: str) -> str:
    """text, its last half of code points replaced by the first as many of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_of(key: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many cuts a key is not before, by bisection: as many steps as the logarithm of their number."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    last = (2**63 - 1, 2**63 - 1)
    padded = F.from_json(F.lit(json.dumps([{"o": o, "h": h} for o, h in cuts + [last] * (sum(steps) - len(cuts))])), "array<struct<o:bigint,h:bigint>>")
    after = lambda at, step: F.when(F.element_at(padded, at + step) <= key, at + step).otherwise(at)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), after) if steps else F.lit(0)
    return F.least(found, F.lit(len(cuts)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (_bucket, _ahead, doc_id, z) sorted in each partition, z the compressed text; behind each bucket's rows stands the one its last row looks ahead to.

    Buckets are ranges of (id, hash of the text), so that rows of one id are dealt as well; only rows
    equal in both stay together. As many figures as there are buckets reach the driver; a bucket has
    about BUCKET_BYTES of text at most, and is walked as a stream.
    """
    spark = docs.sparkSession
    order = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))  # ascends as ids descend
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), order.alias("_o"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts_of(spark), math.ceil(size / BUCKET_BYTES))
    shares = F.from_json(F.lit(json.dumps([i / n for i in range(1, n)])), "array<double>")
    found = rows.agg(F.percentile_approx("_o", shares, max(10_000, 4 * n)).alias("c")).first()["c"] or []
    cuts = []
    for o, group in itertools.groupby(sorted(found)):  # an id that is several cuts is cut by hash
        k = len(list(group))
        cuts += [(o, -(2**63) + (j << 64) // k) for j in range(k)]
    place = F.struct(F.col("_o").alias("o"), F.col("_h").alias("h"))
    rows = rows.withColumn("_bucket", bucket_of(place, cuts).cast("int"))
    heads = sorted((r["_bucket"], r["m"]["o"], r["m"]["h"]) for r in rows.groupBy("_bucket").agg(F.min(place).alias("m")).collect())
    looks = [{"o": o, "h": h, "b": heads[i - 1][0]} for i, (_, o, h) in enumerate(heads)]  # for the bucket before; the first row for the last one
    targets = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(looks)), "array<struct<o:bigint,h:bigint,b:int>>")))
    met = rows.join(F.broadcast(targets), (F.col("_o") == F.col("o")) & (F.col("_h") == F.col("h")))  # as many rows as buckets
    ahead = met.groupBy("b").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"), F.min("_o").alias("_o"), F.min("_h").alias("_h"))
    both = rows.withColumn("_ahead", F.lit(0)).unionByName(ahead.withColumnRenamed("b", "_bucket").withColumn("_ahead", F.lit(1)))

    def squeezed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in row_parts(iter([batch]), "text", PART_BYTES):
                z = pa.array([squeeze.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_bucket", "_ahead", "doc_id", "_o", "_h")), z], names=["_bucket", "_ahead", "doc_id", "_o", "_h", "z"])

    small = both.select("_bucket", "_ahead", "doc_id", "_o", "_h", "text").mapInArrow(tidied(squeezed), "_bucket int, _ahead int, doc_id long, _o long, _h long, z binary")
    return even(small, "_bucket", n).sortWithinPartitions("_bucket", "_ahead", "_o", "_h")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_next(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness and the next document's."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches) -> Iterator[tuple[list, list]]:
        """Texts in order, in parts, and for each the index of the next one in its part, -1 for a text that is only looked at."""
        rows, size, inflate = [], 0, zstandard.ZstdDecompressor()
        for b in batches:
            for *x, z in zip(b.column("_bucket").to_pylist(), b.column("_ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("z").to_pylist()):
                x.append(inflate.decompress(z).decode())
                rows.append(x)
                size += len(x[3])
                if size > PART_BYTES and not x[1]:
                    yield rows
                    rows, size = [x], len(x[3])
        if rows:
            yield rows

    def work(batches):
        walk = Walk(seed)
        for rows in pairs(batches):
            texts = [x[3] for x in rows]
            classes = [classes_of(t) for t in texts]
            ends = walk.ends(classes, [0] * len(texts))
            prints = [walk.fingerprint(c, e) for c, e in zip(classes, ends)]
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]
            new = [edited(texts[i], texts[i + 1]) for i in own]
            kept = [len(texts[i]) - len(texts[i]) // 2 for i in own]
            tails = [classes_of(t[k:]) for t, k in zip(new, kept)]
            more = walk.ends(tails, [int(ends[i][k - 1]) if k else 0 for i, k in zip(own, kept)])
            changed = [walk.fingerprint(np.concatenate([classes[i][:k], c]), np.concatenate([ends[i][:k], e])) for i, k, c, e in zip(own, kept, tails, more)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                [rows[i][2] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(t.encode()).hexdigest() for t in new],
                [prints[i] for i in own], changed,
                [walk.likeness(prints[i], c) for i, c in zip(own, changed)], [walk.likeness(prints[i], prints[i + 1]) for i in own],
            ), schema)], schema=schema)

    return with_next(docs).select("_bucket", "_ahead", "doc_id", "z").mapInArrow(tidied(work), OUT)


def fingerprint(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def work(batches):
        walk = Walk(seed)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text").to_pylist(), walk), pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(work), "doc_id long, fingerprint string")


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 24, bits: int = 12, seed: int = SEED) -> DataFrame:
    """Pairs (doc_id, other_id, near), doc_id the larger: documents that meet in a bit-sampled band and whose likeness is least or more.

    Equal fingerprints are one class: its members are paired with its smallest id, which stands
    for them. Keys come from samples that both texts have, at the level of the shorter one
    (Walk.windows). In a band every two classes of a bucket are compared. Buckets are dealt into
    blocks of about BLOCK classes, and a task compares one pair of blocks at a time, so a bucket
    of n costs n * (n - 1) / 2 comparisons, over several tasks, and n / BLOCK copies of its rows.
    """

    def verify(batches):
        walk = Walk(seed)
        for (_, i, j), (blocks, ids, held) in meetings(batches):
            x, y = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
            near = walk.likenesses([held[k] for k in x], [held[k] for k in y])
            a, b = ids[x][:, None], ids[y][None, :]
            good = (near >= least) & (a != b)
            if i == j:
                good &= a > b
            r, c = np.nonzero(good)
            a, b = ids[x[r]], ids[y[c]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(near[r, c])], names=["doc_id", "other_id", "near"])

    classes = prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")
    keyed = classes.mapInArrow(tidied(lambda batches: band_keys(batches, least, bands, bits, seed, True)), "key long, doc_id long, fingerprint string")
    dealt = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").withColumn("block", F.pmod(F.xxhash64("fingerprint"), dealt).cast("int"))
    sides = blocks.select("*", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("_other")).select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "doc_id", "fingerprint")
    met = sides.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = met.mapInArrow(tidied(verify), "doc_id long, other_id long, near double").groupBy("doc_id", "other_id").agg(F.max("near").alias("near"))
    same = prints.join(classes.withColumnRenamed("doc_id", "other_id"), "fingerprint").where("doc_id <> other_id")
    return near.unionByName(same.select("doc_id", "other_id", F.lit(1.0).cast("double").alias("near")))


def meetings(batches) -> Iterator[tuple[tuple, tuple[np.ndarray, np.ndarray, list[str]]]]:
    """Of rows sorted by (key, i, j): each such group, with its rows' blocks, ids and fingerprints."""
    group, rows = None, []

    def columns():
        blocks, ids, held = zip(*rows)
        return np.array(blocks), np.array(ids, np.int64), list(held)

    for b in batches:
        for *g, block, i, p in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "block", "doc_id", "fingerprint"))):
            if g != group:
                if len(rows) > 1:
                    yield tuple(group), columns()
                group, rows = g, []
            rows.append((block, i, p))
    if len(rows) > 1:
        yield tuple(group), columns()


def band_keys(batches, least: float, bands: int, bits: int, seed: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """(key, doc_id), and the fingerprint as well with whole, of each band of each window of (doc_id, fingerprint)."""
    walk, rng = Walk(seed), np.random.default_rng(seed + 1)
    draws = rng.random((bands, bits))
    mix, band = rng.integers(1, 2**63, (bands, bits), dtype=np.uint64) | np.uint64(1), np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        key, doc, held = [], [], []
        for i, p in zip(b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist()):
            end, packed = p.split(":")
            n = int(np.searchsorted(walk.at, int(end, 16)))
            got = np.unpackbits(np.frombuffer(bytes.fromhex(packed), np.uint8))[:n]
            for level, low, span in walk.windows(n, least):
                h = np.where(got[low + (draws * span).astype(np.int64)] if span else np.zeros((bands, bits), bool), mix, 0).sum(1, dtype=np.uint64)
                h = (h ^ band ^ np.uint64(level << 48)) * np.uint64(0xD6E8FEB86659FD93)
                key.append(h ^ (h >> np.uint64(32)))
                doc.append(np.full(bands, i))
                held += [p] * bands if whole else []
        if key:
            columns = [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.string())] if whole else []), names=["key", "doc_id"] + (["fingerprint"] if whole else []))


def sharing(batches) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id) sorted by key those whose key others have as well, and how many came before."""
    key, first, rank = None, None, 0
    for b in batches:
        k, d = b.column("key").to_numpy(), b.column("doc_id").to_numpy()
        if not len(k):
            continue
        begins = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(k)), -1))
        ranks = np.where(at < 0, np.arange(len(k)) + rank + 1, np.arange(len(k)) - at)
        firsts = np.where(at < 0, first if first is not None else 0, d[np.maximum(at, 0)])
        use = ranks > 0
        second = ranks == 1  # the first member goes with the second
        columns = (np.concatenate([k[use], k[second]]), np.concatenate([d[use], firsts[second]]), np.concatenate([ranks[use], np.zeros(int(second.sum()), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc_id", "rank"])
        key, first, rank = k[-1], int(firsts[-1]), int(ranks[-1])


def near_classes(prints: DataFrame, least: float = 0.8, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(doc_id, near_class) of the documents (doc_id, fingerprint) that a smaller id stands for: the smallest that links of likeness least or more lead to.

    A bucket is verified in pairs of blocks of STARS classes, over several tasks, and gives what hangs
    together there, never its pairs.
    """

    def verify(batches):
        walk = Walk(seed)
        for _, (_, ids, held) in meetings(batches):
            a, b = walk.hanging(held, least)
            if len(a):
                nodes, low = roots(ids[a], ids[b])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], names=["a", "b"])

    known = prints.where("doc_id IS NOT NULL").select("doc_id", "fingerprint")
    classes = written(known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint"), "classes")
    bits = max(12, classes.count().bit_length() + SPARE_BITS)
    bands = math.ceil(math.log(1 - recall) / math.log(1 - ((1 + least) / 2) ** bits))
    keyed = classes.mapInArrow(tidied(lambda batches: band_keys(batches, least, bands, bits, seed, False)), "key long, doc_id long")
    met = written(keyed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(tidied(sharing), "key long, doc_id long, rank long"), "met")
    large = met.where((F.col("rank") > 0) & (F.col("rank") % STARS == 0)).groupBy("key").agg((F.max("rank") / STARS).cast("int").alias("last"))
    if large.limit(1).count():
        sized = met.join(large, "key", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    else:
        sized = met.withColumn("last", F.lit(0))
    block = F.floor(F.col("rank") / STARS).cast("int").alias("block")
    sides = sized.select("key", "doc_id", block, F.explode(F.sequence(F.lit(0), "last")).alias("_other")).select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "doc_id")
    placed = sides.join(classes, "doc_id").select("key", "i", "j", "block", "doc_id", "fingerprint").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    label = components(placed.mapInArrow(tidied(verify), "a long, b long")).withColumnRenamed("id", "rep")
    name = F.struct(F.xxhash64("fingerprint").alias("a"), F.xxhash64(F.lit(1), "fingerprint").alias("b")).alias("name")
    named = classes.select(F.col("doc_id").alias("rep"), name).join(label, "rep", "left").select("name", F.coalesce("component", "rep").alias("near_class"))
    return known.select("doc_id", name).join(named, "name").where("near_class <> doc_id").groupBy("doc_id").agg(F.min("near_class").alias("near_class"))


def op8(docs: DataFrame) -> DataFrame:
    """The digest of compare_next()."""
    return compare_next(docs)
