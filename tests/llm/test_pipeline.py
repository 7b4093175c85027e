"""The whole pipeline against plain versions of its stages, on planted cases."""

import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_pairs import components, edits
from tidelog.llm import decontaminate, pieces, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _row string, _score string"


def plain_score(m, text):
    """The machine's score with every pair of features multiplied out."""
    data = (text or "").encode()
    found = data.lower().split()
    counts = {}
    for w in found:
        counts[zlib.crc32(w) % quality.BUCKETS] = counts.get(zlib.crc32(w) % quality.BUCKETS, 0) + 1
    root = math.sqrt(sum(counts.values())) or 1.0
    kinds = [0] * 8
    for b in data:
        kinds[int(quality.KINDS[b])] += 1
    size, lines = max(1, len(data)), data.split(b"\n")
    dense = [k / size for k in kinds] + [
        math.log1p(size), math.log1p(len(found)), len(set(found)) / max(1, len(found)), max(counts.values()) / len(found) if found else 0.0, size / max(1, len(found)) / 10,
        len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(size / len(lines)), float(not found),
    ]
    x = {i: math.sqrt(n) / root for i, n in counts.items()}
    x |= {quality.BUCKETS + j: min(5.0, max(-5.0, (v - m.mean[j]) / m.scale[j])) for j, v in enumerate(dense)}
    z = m.w0 + sum(m.w[i] * v for i, v in x.items())
    on = list(x)
    z += sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for k, i in enumerate(on) for j in on[:k])
    return 1 / (1 + math.exp(-z))


def plain_cut(rows):
    """Texts without the bytes that 100 bytes starting earlier cover, and without characters cut in part."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.setdefault(w, (i, p))
        for p in range(len(data)):  # the whole of a character goes with any of its bytes
            if data[p] & 0xC0 != 0x80:
                end = p + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                if any(covered[p:end]):
                    covered[p:end] = b"\1" * (end - p)
        out[i] = None if t is None else bytes(c for c, x in zip(data, covered) if not x).decode()
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and poor texts, exact and near copies, passages of over 50 words, benchmark items, nulls and empties."""
    at, rng = tmp_path_factory.mktemp("sf"), random.Random(21)
    good = [words(rng, rng.randrange(30, 90)) for _ in range(60)]
    poor = [" | ".join(rng.choice(["x$$", "y###", "zz%%", "q***"]) for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    passage = words(rng, 70) + " é中 "
    items = [(i, words(rng, rng.randrange(8, 20))) for i in range(6)] + [(90, None), (91, "")]
    texts = good + poor
    for t in good[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts += [t, " ".join(w)]
    texts += [words(rng, 25) + " é " + passage + words(rng, 25) for _ in range(5)]
    for i, x in items[:6]:
        y = list(x)
        y[len(y) // 2] = "#"
        texts += [words(rng, 20) + " " + x.upper().replace(" ", "\n", 2) + " " + words(rng, 20), words(rng, 30) + " " + "".join(y)]
    texts += [None, "", "  ", "a few good words"]
    rows = [(n, t, "en", "web", None if t is None else len(t), "clash", "clash", "clash") for n, t in enumerate(texts)]
    labels = [(n, int(n < 60), 0) for n in range(100)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), [(r[0], r[1]) for r in rows], items


def test_stages_against_plain_versions(spark, folder):
    import sentencepiece

    sf, rows, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {i: plain_score(machine, t) for i, t in rows}
    assert not any(0.2999 < s < 0.3001 for s in scores.values())
    kept = [(i, t) for i, t in rows if scores[i] >= 0.3]
    assert all(scores[i] < 0.3 for i in range(60, 100)) and all(scores[i] >= 0.3 for i in range(60))
    first = {i for i, _, c, _ in components(kept, 5, (80, 100)) if i == c}
    kept = [(i, t) for i, t in kept if i in first]
    assert len(rows) - 40 - len(kept) >= 12  # the exact copies, and near ones of longer texts
    cut = plain_cut(kept)
    leaks = lambda t: any(
        edits(x, decontaminate.normal(t)) <= decontaminate.budget(len(x)) if len(x) >= decontaminate.Q else x in decontaminate.normal(t) for x in (decontaminate.normal(y) for _, y in items) if x
    )
    left = {i: t for i, t in cut.items() if not leaks(t)}
    assert len(cut) - len(left) == 12
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: sp.encode(t or "") for i, t in left.items()} and len(got) == len(left)


def test_stages_of_nothing(spark, folder):
    sf, _, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.limit(0), sf)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == 0


def test_quality_of_features_in_batches(folder):
    """The classifier's own features and those of the plain score are the same figures."""
    _, rows, _ = folder
    m = quality.Machine(0.1, np.random.default_rng(1).normal(size=quality.BUCKETS + quality.DENSE), np.random.default_rng(2).normal(size=(quality.BUCKETS + quality.DENSE, quality.FACTORS)) / 9, np.zeros(quality.DENSE), np.ones(quality.DENSE))
    for _, t in rows[::7]:
        assert m.score(*quality.features(t, quality.Buckets())) == pytest.approx(plain_score(m, t), abs=1e-9)
