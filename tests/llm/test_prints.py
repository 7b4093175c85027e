"""Fingerprints against a plain version of their own, over any number of partitions."""

import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import edit_embedding

SEED = edit_embedding.SEED


class Plain:
    """The shared walk, step by step; draws in the order that Walk makes them."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.moves = rng.integers(0, 2, (256, 4096), dtype=np.uint8)
        self.moves[:, 4095] = 1
        self.at, self.weight = list(range(64)), [1.0] * 64
        for level in range(6, edit_embedding.LEVELS):
            self.at += sorted(rng.integers(2**level, 2 ** (level + 1), 64).tolist())
            self.weight += [2.0**level / 64] * 64
        self.bits = rng.integers(0, 2, (len(self.at), 256), dtype=np.uint8)

    def embedding(self, text):
        out = []
        for x in map(ord, text):
            c = x if x < 128 else (128 + (x * 2654435761 % 2**32 >> 25)) % 256
            while True:
                out.append(c)
                if self.moves[c][(len(out) - 1) % 4096]:
                    break
        return out

    def sampled(self, text):
        e = self.embedding(text)
        return len(e), [int(self.bits[k][e[p]]) for k, p in enumerate(self.at) if p < len(e)]

    def print(self, text):
        end, bits = self.sampled(text)
        bits = bits + [0] * (-len(bits) % 8)
        return f"{end:x}:" + "".join(f"{int(''.join(map(str, bits[i : i + 8])), 2):02x}" for i in range(0, len(bits), 8))

    def likeness(self, a, b):
        (end_a, x), (end_b, y) = self.sampled(a), self.sampled(b)
        if not x and not y:
            return float(end_a == end_b)
        both, most = min(len(x), len(y)), max(len(x), len(y))
        differ = sum(w for i, j, w in zip(x, y, self.weight) if i != j) + sum(self.weight[both:most]) / 2
        return max(0.0, 1 - 2 * differ / sum(self.weight[:most]))


def expected(rows):
    """The contract's rows by the plain walk; rows of one id in any order that the hash of the text gives."""
    plain, out = Plain(), []
    for (i, t), (_, follow) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + follow[:half]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain.print(t), plain.print(new), plain.likeness(t, new), plain.likeness(t, follow)))
    return sorted(out, key=str)


def texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefgh é中\n") for _ in range(rng.choice([0, 1, 3, 20, 90, 400]))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("near_class").collect()), key=str)


@pytest.mark.parametrize("parts", [4, 300, 2000])
def test_any_number_of_partitions(spark, parts):
    rows = [(n * 7, t) for n, t in enumerate(texts(250))][::-1]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        query = edit_embedding.op8 if parts == 4 else edit_embedding.compare_next
        assert rows_of(query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_rows_of_one_id_are_dealt(spark):
    """A third of the rows without an id, and a third of one id: buckets cut them by hash, and each row has a next one."""
    found = [(None if n % 3 == 0 else 5 if n % 3 == 1 else n, t + str(n)) for n, t in enumerate(texts(300))]
    df = spark.createDataFrame(found, "doc_id long, text string")
    buckets = edit_embedding.with_next(df).where("_ahead = 0").groupBy("doc_id", "_bucket").count().collect()
    assert sum(r["doc_id"] is None for r in buckets) > 1 and sum(r["doc_id"] == 5 for r in buckets) > 1
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    rows = sorted(found, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r]))
    assert rows_of(edit_embedding.op8(df)) == expected(rows)


def test_bisection_finds_each_bucket(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 8, 50):
        cuts = sorted((rng.randrange(40), rng.randrange(-5, 5)) for _ in range(n))
        keys = [(rng.randrange(40), rng.randrange(-5, 5)) for _ in range(200)]
        df = spark.createDataFrame(keys, "o long, h long").selectExpr("*", "struct(o, h) AS k")
        got = df.select("o", "h", edit_embedding.bucket_of(df["k"], cuts).alias("b")).collect()
        assert all(r["b"] == sum(c <= (r["o"], r["h"]) for c in cuts) for r in got)


@pytest.mark.parametrize("block, texts_of", [(4096, 1500), (3, 400)])
def test_near_classes(spark, monkeypatch, block, texts_of):
    """Recall of links against all pairs of fingerprints, and no class without links."""
    monkeypatch.setattr(edit_embedding, "STARS", block)
    rng, walk = random.Random(11), edit_embedding.Walk()
    rows = []
    while len(rows) < texts_of:
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.choice([5, 40, 300, 900])))
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            x = list(base)
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = rng.choice("#$%")
            rows.append("".join(x))
    prints = edit_embedding.fingerprints(rows, walk)
    near = walk.likenesses(prints, prints) >= 0.8
    df = spark.createDataFrame([*enumerate(prints), (None, prints[0])], "doc_id long, fingerprint string")
    found = {r["doc_id"]: r["near_class"] for r in edit_embedding.near_classes(df).collect()}
    label = [found.get(i, i) for i in range(len(rows))]
    same = np.equal.outer(label, label)
    pairs = np.triu(near, 1)
    assert pairs.sum() > 100 and (pairs & same).sum() / pairs.sum() >= 0.95
    true = list(range(len(rows)))
    for _ in range(30):  # the components of all links
        true = [min(true[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    assert all(true[i] == true[j] for i, j in found.items()) and all(j < i for i, j in found.items())


def test_near_classes_of_few_texts(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    rows = [(5, text), (3, text), (9, text[:250] + "#" + text[250:]), (4, "other words"), (None, text), (2, None), (1, "")]
    prints = edit_embedding.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["near_class"] for r in edit_embedding.near_classes(prints).collect()}
    assert {i: c for i, c in got.items() if i != 9} == {5: 3, 2: 1} and got.get(9, 3) == 3
