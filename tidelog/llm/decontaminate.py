"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

A document leaks an item if some part of it is within k = EDITS * length edits of the
whole item, both lower-cased and with runs of white space as one blank. An item of m
characters that survives k edits keeps at least m - q + 1 - k q of its q-grams, on
2 k + 1 neighbouring diagonals. Hits are counted in bands of twice that width which
overlap by half, so that one band holds them all; bands below the bound are dropped and
the rest, neighbours together, aligned within their diagonals. Nothing that qualifies is
missed. A gram that an item repeats counts for every band that one of its places may lie
in, once for each place of the text: a bound from above, so that runs of one character
cost no more than other text.

The items' index is broadcast in blocks of at most BLOCK characters, however large the
benchmark; each block is one pass over the documents. Items shorter than q characters
must occur exactly; empty and null items never match. A null text is an empty one.
Documents are searched whole, in pieces that overlap by more than any item's reach.
Rows that share a doc_id are searched each; a pair is reported once, at its best place,
with the number of places, those that overlap being one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_parts, tidied

Q, EDITS = 10, 0.05
#: Characters of items in one broadcast block; of a document in one piece, at least.
BLOCK, PIECE = 4_000_000, 1 << 16
#: Places of a gram in an item beyond which they are taken as a range; postings counted at a time; diagonals aligned at a time.
MOST_PLACES, EXPANDED, WIDEST = 4, 1 << 20, 1 << 16
BITS = 22
#: No character's code point.
BEYOND = 1 << 31
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
PAIRS = "doc_id long, item_id long, distance int, start long, length int, places int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place on."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h1 = (codes.astype(np.uint64) + np.uint64(1)) * ODD[0]
    h2 = h1[:-1] * ODD[1] + h1[1:]
    h4 = h2[:-2] * ODD[2] + h2[2:]
    h8 = h4[:-4] * ODD[3] + h4[4:]
    h = h8[:n] * ODD[4] + h2[8 : 8 + n]
    return h ^ (h >> np.uint64(32))


def budget(m: int) -> int:
    """Edits an item of m characters may differ by; fewer where the lemma would promise no q-gram."""
    return max(0, min(math.floor(EDITS * m), (m - Q) // Q))


@dataclass
class Index:
    ids: list
    texts: list[str]
    grams: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # where each one's postings begin
    item: np.ndarray
    low: np.ndarray  # least and greatest place of the posting in its item
    high: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    reach: int
    short: list[tuple[int, np.ndarray, np.ndarray]]  # length, sorted hashes, items: of those shorter than Q

    @staticmethod
    def of(rows: list[tuple]) -> Index:
        ids, texts = [r[0] for r in rows], [normal(r[1]) for r in rows]
        hashes = [gram_hashes(points(t)) for t in texts]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(rows)), [len(h) for h in hashes]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        # A gram that an item has at more than MOST_PLACES places is one posting from the first to the last.
        begins = np.ones(len(every), bool)
        begins[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1])
        group = np.cumsum(begins) - 1
        often = np.bincount(group)[group] > MOST_PLACES if len(group) else begins
        last = np.append(np.flatnonzero(begins)[1:], len(every)) - 1
        high = np.where(often, place[last[group]], place) if len(group) else place
        kept = begins | ~often
        every, item, place, high = every[kept], item[kept], place[kept], high[kept]
        grams, first = np.unique(every, return_index=True)
        bits = np.zeros(1 << BITS, bool)
        bits[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
        size = np.array([len(t) for t in texts], np.int64)
        edits = np.array([budget(m) for m in size], np.int64)
        reach = int((size + 6 * edits + 6).max()) if len(rows) else 0
        short = []
        for n in range(1, Q):
            own = np.flatnonzero(size == n)
            if len(own):
                h = np.array([span_hashes(points(texts[i]), n)[0] for i in own])
                order = np.argsort(h, kind="stable")
                short.append((n, h[order], own[order]))
        return Index(ids, texts, grams, np.append(first, len(every)), item, place, high, bits, size, edits, reach, short)


def span_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place on, n less than Q."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = h * ODD[0] + codes[k : k + len(h)].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal from low to high that an alignment of the whole item ends on: its least edits, and the part of the text, start and end."""
    m, width = len(item), high - low + 1
    far = 1 << 20
    column = np.arange(width)
    cost = np.where((low + column >= 0) & (low + column <= len(text)), 0, far)
    start = low + column
    padded = np.full(width + m, BEYOND, np.int64)  # the text from low on; no character beyond its ends
    a, b = max(0, low), min(len(text), low + width + m)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i in range(m):
        here = padded[i : i + width]  # each diagonal's next character
        step = np.where(here < BEYOND, cost + (here != item[i]), far)
        above, origin = np.append(cost[1:] + 1, far), np.append(start[1:], 0)  # an item character left out
        use = above < step
        step, origin = np.where(use, above, step), np.where(use, origin, start)
        # text characters put in: from the left along the row
        lifted = step - column
        best = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == best, column, 0))
        cost, start = best + column, origin[source]
    return cost, start, low + m + column


def bands(hit: np.ndarray, gram: np.ndarray, size: int, index: Index) -> dict[int, np.ndarray]:
    """For each item the bands, in order, that a piece's hits may fill up to the item's bound.

    Band b of an item covers the diagonals from b strides on, two strides of 2 k + 1 each.
    Postings are counted EXPANDED at a time; one with a range of places counts for each band it meets.
    """
    count = index.first[gram + 1] - index.first[gram]
    ends = np.cumsum(count)
    width = np.int64(2 * size + 4 * index.reach + 8)
    singles, ranges, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [], 0
    while at < len(hit):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, side="right")))
        n = count[at:stop]
        posting = np.repeat(index.first[gram[at:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, item = np.repeat(hit[at:stop], n), index.item[posting]
        stride = 2 * index.edits[item] + 1
        left, right = (place - index.high[posting]) // stride, (place - index.low[posting]) // stride
        one = index.low[posting] == index.high[posting]
        half, held = np.unique(item[one] * width + left[one] + index.reach + 2, return_counts=True)
        singles.append((half, held))
        many = np.flatnonzero(~one)
        if len(many):
            ranges.append((item[many], left[many] - 1, right[many]))
        at = stop
    half, held = (np.concatenate(x) for x in zip(*singles))
    key, back = np.unique(np.concatenate([half, half - 1]), return_inverse=True)
    total = np.bincount(back.ravel(), np.concatenate([held, held]), minlength=len(key)).astype(np.int64)
    which, band = key // width, key % width - index.reach - 2
    least = index.size - Q + 1 - Q * index.edits
    wide = np.unique(np.concatenate([r[0] for r in ranges])) if ranges else np.zeros(0, np.int64)
    kept = (total >= least[which]) & ~np.isin(which, wide)
    out = {int(i): band[kept & (which == i)] for i in np.unique(which[kept])}
    for i in wide.tolist():
        first, last = (np.concatenate([r[k][r[0] == i] for r in ranges]) for k in (1, 2))
        own = which == i
        begin = min(int(first.min()), int(band[own].min(initial=first.min())))
        end = max(int(last.max()), int(band[own].max(initial=last.max()))) + 2
        dense = np.cumsum(np.bincount(first - begin, minlength=end - begin) - np.bincount(last + 1 - begin, minlength=end - begin))
        dense[band[own] - begin] += total[own]
        if len(found := np.flatnonzero(dense >= least[i])):
            out[i] = found + begin
    return out


def stretches(found: np.ndarray, stride: int) -> Iterator[tuple[int, int]]:
    """Diagonals (low, high) of bands that overlap, in parts of WIDEST that overlap by a band."""
    for run in np.split(found, np.flatnonzero(np.diff(found) > 1) + 1):
        low, high = int(run[0]) * stride, (int(run[-1]) + 2) * stride - 1
        while high - low + 1 > WIDEST + 2 * stride:
            yield low, low + WIDEST + 2 * stride - 1
            low += WIDEST
        yield low, high


def leaks(text: str, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item's index, distance, start, length, places) for every item that a normalised text leaks; places that overlap are one."""
    best: dict[int, tuple[int, int, int]] = {}
    spans: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def put(i: int, cost, start, end):
        at = np.lexsort((end, start, cost))[0]
        new = int(cost[at]), int(start[at]), int(end[at] - start[at])
        best[i] = min(best.get(i, new), new)
        spans.setdefault(i, []).append((start, end))

    codes = points(text)
    size = max(PIECE, 4 * index.reach)
    for at in range(0, max(1, len(codes)), size):
        piece = codes[at : at + size + index.reach]
        h = gram_hashes(piece)
        hit = np.flatnonzero(index.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if len(hit) and len(index.grams):
            k = np.minimum(np.searchsorted(index.grams, h[hit]), len(index.grams) - 1)
            good = index.grams[k] == h[hit]
            for i, found in bands(hit[good], k[good], len(piece), index).items() if good.any() else ():
                item = points(index.texts[i])
                for low, high in stretches(found, 2 * int(index.edits[i]) + 1):
                    cost, start, end = align(item, piece, low, high)
                    near = cost <= index.edits[i]
                    if near.any():
                        put(i, cost[near], start[near] + at, end[near] + at)
    for n, known, items in index.short:
        h = span_hashes(codes, n)
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[k] == h)
        for value in np.unique(h[hit]):
            for i in items[known == value].tolist():
                start = hit[h[hit] == value]
                start = start[[text[x : x + n] == index.texts[i] for x in start.tolist()]]
                if len(start):
                    put(i, np.zeros(len(start), np.int64), start, start + n)
    out = []
    for i, (distance, first, length) in best.items():
        start, end = (np.concatenate(x) for x in zip(*spans[i]))
        order = np.lexsort((end, start))
        covered = np.maximum.accumulate(end[order])
        out.append((i, distance, first, length, 1 + int((start[order][1:] >= covered[:-1]).sum())))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) with the best place of each in the normalised text; with key, a string column, triples (doc_id, key, item_id)."""
    keys = ["doc_id", *([key] if key else [])]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND text <> ''").distinct()
    characters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * characters / BLOCK))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys[1:], "text")
    schema = pa.schema([*((k, pa.string()) for k in keys[1:]), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("places", pa.int32())])

    def passed(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index.of(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r)))
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches):
            index = sent.value
            for part in row_parts(batches, "text", 4 << 20):
                rows = zip(*(part.column(c).to_pylist() for c in (*keys[1:], "doc_id", "text")))
                out = [(*row, index.ids[i], *rest) for *row, text in rows for i, *rest in leaks(normal(text), index)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return own.mapInArrow(tidied(search), ", ".join([*(f"{k} string" for k in keys[1:]), PAIRS]))

    found = passed(0)
    for block in range(1, blocks):
        found = found.unionByName(passed(block))
    best = F.min(F.struct("distance", "start", "length", "places")).alias("best")
    return found.groupBy(*keys, "item_id").agg(best).select(*keys, "item_id", "best.*")


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every leak: one row per document and item."""
    return contamination(docs, benchmark)
