"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its lower-cased words hashed into BUCKETS (root of the counts,
scaled to unit length) and dense figures of its structure and metadata (lengths, shares
of kinds of characters, repetition). The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

which the sum-of-squares identity gives in time linear in the document's features.

The machine is fitted on at most ``most_rows`` labelled rows (a documented bound, taken
by a hash of the id) outside the held-out fold; every document is scored, over its whole
text. A null text is an empty one; empty texts have structure features only. Rows of
``labels`` with a null are not used; of contradicting rows the mean counts. A null
doc_id is never learned from. Without labels of both kinds every score is the share of
label 1, or 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nested, tidied

BUCKETS = 1 << 13
FACTORS = 8
#: Labelled rows that the machine is fitted on, at most.
MOST_ROWS = 8192
FOLDS = 5
#: Length of a step, and decay of weights.
RATE, DECAY = 0.02, 1e-5
#: Words whose buckets a worker remembers.
MOST_WORDS = 300_000


class Buckets(dict):
    """Bucket of each word seen; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % BUCKETS
        return bucket


#: Kinds of bytes: lower, upper, digit, space, newline, sentence marks, other ASCII signs, beyond ASCII.
KINDS = np.zeros(256, np.int64)
KINDS[33:128] = 6
KINDS[ord("a") : ord("z") + 1], KINDS[ord("A") : ord("Z") + 1], KINDS[ord("0") : ord("9") + 1] = 0, 1, 2
KINDS[:33], KINDS[10], KINDS[[ord(c) for c in ".,;:!?'\"-"]], KINDS[128:] = 3, 4, 5, 7
DENSE = 17


def features(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that occur, their values, and the dense figures."""
    data = (text or "").encode()
    words = data.lower().split()
    n, size = len(words), max(1, len(data))
    at, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, n), return_counts=True)
    values = np.sqrt(counts.astype(np.float64))
    values /= np.sqrt((values**2).sum()) or 1.0
    kinds = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=8) / size
    lines = data.split(b"\n")
    top = counts.max() / n if n else 0.0
    dense = [
        *kinds, np.log1p(size), np.log1p(n), len(set(words)) / max(1, n), top, size / max(1, n) / 10,
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(size / len(lines)), float(n == 0),
    ]
    return at, values, np.array(dense)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, at: np.ndarray, values: np.ndarray, dense: np.ndarray) -> float:
        """Linear in the number of features: words through at, structure after them."""
        d = np.clip((dense - self.mean) / self.scale, -5, 5)
        w, v = np.concatenate([self.w[at], self.w[BUCKETS:]]), np.concatenate([self.v[at], self.v[BUCKETS:]])
        x = np.concatenate([values, d])
        s = x @ v
        z = self.w0 + x @ w + 0.5 * float((s * s).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def gradients(m: Machine, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss over the rows of x, with weight decay, by w0, w and v."""
    s = x @ m.v
    z = m.w0 + x @ m.w + 0.5 * ((s * s).sum(1) - (x * x) @ (m.v * m.v).sum(1))
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    return float(g.sum()), x.T @ g + DECAY * m.w, x.T @ (g[:, None] * s) - m.v * ((x * x).T @ g)[:, None] + DECAY * m.v


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5, epochs: int = 12, batch: int = 128) -> Machine:
    """Adam on the logistic loss with weight decay; batches in an order fixed by the seed."""
    rng, n = np.random.default_rng(seed), len(rows)
    size = BUCKETS + DENSE
    dense = np.array([r[2] for r in rows]).reshape(n, DENSE)
    mean, scale = (dense.mean(0), dense.std(0) + 1e-3) if n else (np.zeros(DENSE), np.ones(DENSE))
    share = min(0.999, max(0.001, float(labels.mean()))) if n else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), mean, scale)
    if n == 0 or share in (0.001, 0.999):
        return m
    dense = np.clip((dense - mean) / scale, -5, 5)
    m.v = rng.normal(0, 0.01, (size, FACTORS))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for first in range(0, n, batch):
            part = order[first : first + batch]
            x = np.zeros((len(part), size))
            for i, k in enumerate(part):
                x[i, rows[k][0]] = rows[k][1]
            x[:, BUCKETS:] = dense[part]
            g0, *grads = gradients(m, x, labels[part])
            step += 1
            m.w0 -= RATE * g0
            for p, grad, (a, b) in zip((m.w, m.v), grads, moments):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def held_out() -> F.Column:
    """Fold 0 of the checksum of the id's digits; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )

    def figures(batches):
        buckets = Buckets()
        for b in batches:
            rows = [features(t, buckets) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_label"), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
                names=["doc_id", "label", "at", "val", "dense"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = (
        own.join(F.broadcast(chosen), "doc_id")  # at most most_rows rows
        .mapInArrow(tidied(figures), "doc_id long, label int, at binary, val binary, dense binary")
        .dropDuplicates(["doc_id"]).collect()
    )
    found.sort(key=lambda r: r["doc_id"])
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["val"], np.float32).astype(float), np.frombuffer(r["dense"])) for r in found]
    return fit(rows, np.array([r["label"] for r in found], float))


def score(docs: DataFrame, machine: Machine, column: str = "_score") -> DataFrame:
    """docs, each row with its score in a column, which replaces one of that name."""
    others = [c for c in docs.columns if c.lower() != column.lower()]
    return scored(docs, machine).select(*[F.col(f"_row.`{c}`").alias(c) for c in others], F.col("_score").alias(column))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(_row, _score): each row of docs as a struct, and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # some 600 KB, whatever the input
    own = docs.select(nested(docs), F.col("text").alias("_text"))
    schema = T.StructType([own.schema["_row"], T.StructField("_score", T.DoubleType())])

    def scores(batches):
        buckets, m = Buckets(), sent.value
        for b in batches:
            found = pa.array([m.score(*features(t.as_py(), buckets)) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_row"), found], names=["_row", "_score"])

    return own.mapInArrow(tidied(scores), schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of score(): every document, with the threshold 0.3."""
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
