"""Packing, pieces, licenses, quality, WARC, sharding and the pipeline."""

import base64
import functools
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import assert_same, duck
from tidelog.llm import decontaminate, licences, packing, pieces, quality, queries, set_join, sharding, suffix_dedup, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def chunked(p, text, size):
    s, out = pieces.marked_text(text), []
    for at in range(0, len(s), size):
        first, end = max(0, at - p.longest), min(len(s), at + size)
        out.append((s[first : end + p.longest], at - first, end - first))
    matrices = [p.transfer(*c) for c in out]
    states = pieces.border_states(matrices) if matrices else []
    if len(matrices) > 3:  # down a tree of two levels
        cut = len(matrices) // 2
        outer = pieces.border_states([pieces.product(matrices[:cut]), pieces.product(matrices[cut:])])
        assert states == pieces.border_states(matrices[:cut], *outer[:2])[:-1] + pieces.border_states(matrices[cut:], *outer[1:])
    return b"".join(p.chunk_ids(*c, a, b) for c, a, b in zip(out, states, states[1:])), matrices


def test_chunks_give_the_libraries_ids(processor):
    p, rng = pieces.Pieces(*pieces.load_model(pieces.default_model())), random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice(["the", "tion", "er", " ", "  ", "\n", "中", "é", "x", "▁", "\r\n", "1", "don't", ".", ","]) for _ in range(rng.randrange(0, 60)))
        ids, matrices = chunked(p, text, rng.choice([1, 2, 3, 7, 20]))
        assert np.frombuffer(ids, np.int32).tolist() == processor.encode(text)
        assert p.decode(ids) == text.replace("▁", " ")
        if len(matrices) >= 3:
            a, b, c = matrices[:3]
            assert pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))


def test_unigram_lattice():
    p = pieces.Pieces.__new__(pieces.Pieces)
    rng = random.Random(3)
    names = [" ", "a", "b", "c", "ab", "bc", "abc", " a", "ca", "caab", "bb"]
    p.ids, p.score = {x: i for i, x in enumerate(names)}, {i: -rng.random() * 5 - 1 for i in range(len(names))}
    p.names, p.kind, p.longest, p.unknown_score = {i: x for x, i in p.ids.items()}, pieces.UNIGRAM, 4, -50.0
    p.pairs = {x[i : i + 2] for x in names for i in range(len(x) - 1)}
    p.fallback, p.feed, p.fragments, p.table = False, False, re.compile("(?s).+"), []
    p.sp = type("Unk", (), {"unk_id": staticmethod(lambda: 99)})
    p.known = pieces.Known(p)

    def best(s):
        score = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 4), e):
                w = p.score[p.ids[s[b:e]]] if s[b:e] in p.ids else p.unknown_score if e - b == 1 else -np.inf
                score[e] = max(score[e], score[b] + w)
        return score[-1]

    for _ in range(60):
        text = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 40)))
        ids, _ = chunked(p, text, rng.choice([1, 3, 8]))
        got = np.frombuffer(ids, np.int32).tolist()
        assert sum(p.score.get(i, p.unknown_score) for i in got) == pytest.approx(best(pieces.marked_text(text)))


@pytest.mark.parametrize("chunk", [40, pieces.CHUNK])
def test_encode_and_decode(docs, fixture_rows, none, processor, chunk):
    got = pieces.encode(docs, chunk=chunk)
    rows = got.collect()
    assert len(rows) == len(fixture_rows)
    expected = sorted(((i, len(t or ""), processor.encode(t or "")) for i, t in fixture_rows), key=str)
    assert sorted(((r["doc_id"], r["n_chars"], list(r["ids"])) for r in rows), key=str) == expected
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect() if r["doc_id"] is not None}
    assert all(decoded[i] == (t or "").replace("▁", " ") for i, t in fixture_rows if i is not None)
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], np.int32).tobytes()).hexdigest() for r in rows)
    assert pieces.op3(none).count() == 0


def unigram_model(path):
    """A model made by hand: letters, some syllables and bytes, with scores."""
    from sentencepiece import sentencepiece_model_pb2

    m, rng = sentencepiece_model_pb2.ModelProto(), random.Random(4)
    names = ["a", "b", "c", "d", "\u2581", "ab", "bc", "abc", "\u2581a", "ca", "cad", "bb", "dad", "\u2581ab", "dc"]
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(x, -rng.random() * 5 - 1, 1) for x in names]
    for piece, score, kind in rows:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, True, len(rows)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_model(spark, tmp_path):
    import sentencepiece

    path, rng = unigram_model(tmp_path / "u.model"), random.Random(7)
    rows = [(i, "".join(rng.choice("aaabbbcccddd  \u00e9") for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(60)]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, chunk=11).collect()}
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for i, t in rows:  # of two best paths either will do
        assert got[i] == sp.encode(t) or score(got[i]) == pytest.approx(score(sp.encode(t)), abs=1e-3)
        assert sp.decode(got[i]) == sp.decode(sp.encode(t))
    assert sum(got[i] == sp.encode(t) for i, t in rows) > 50


def test_giant_text_over_many_tasks(spark, processor):
    """Five million characters, some without any place that no piece spans; chunks over all tasks, a tree of three levels."""
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "tion", "er", "  ", "\n", "\u4e2d", "\u00e9", "x", "1", "don't ", ".", "a" * 50]) for _ in range(600_000))
    frame = spark.createDataFrame([(1, text), (2, "short"), (None, text[:100_000])], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        got = {r["doc_id"]: r for r in pieces.encode(frame, chunk=1000, with_ids=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for i, t in ((1, text), (2, "short"), (None, text[:100_000])):
        ids = np.array(processor.encode(t), np.int32)
        assert got[i]["n_pieces"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        most = rng.randrange(1, 50)
        sizes = [rng.randrange(1, most + 1) for _ in range(rng.randrange(0, 50))]
        rows, room = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(room[k], k) for k in range(len(rows)) if room[k] >= sizes[i]]
            k = min(fits)[1] if fits else len(rows)
            if not fits:
                rows.append([])
                room.append(most)
            rows[k].append(i)
            room[k] -= sizes[i]
        got = packing.best_fit(sizes, most)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert sorted(most - sum(sizes[i] for i in r) for r in got) == sorted(room)


def test_packing(spark, docs, fixture_rows, none, processor, tmp_path):
    packed = packing.pack(docs, most=64)
    parts: dict = {}
    for r in packed.collect():
        ids, positions = np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["positions"], np.uint16)
        assert len(ids) == len(positions) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((s, ids[a:b].tolist()))
    for i, t in fixture_rows:
        expected = processor.encode(t or "")
        if i is not None:
            assert [x for _, y in sorted(parts.get(i, [])) for x in y] == (expected + [2] if expected else [])
    files = packing.write_matrices(packed, f"file://{tmp_path}/m")
    files = spark.createDataFrame(files.collect(), files.schema)
    for f in files.collect():
        at = f["path"].removeprefix("file://")
        matrix = np.fromfile(f"{at}.ids.bin", np.uint16).reshape(-1, 64)
        starts, lengths = np.fromfile(f"{at}.rows.bin", packing.ROWS)["at"], np.fromfile(f"{at}.cu_seqlens.bin", np.int32)
        assert len(matrix) == len(starts) == f["n_rows"] and (lengths[starts] == 0).all()
    assert sorted(map(str, packing.read_matrices(files).collect())) == sorted(map(str, packed.collect()))
    whole = packing.op1(docs)
    assert sorted(r["n_tokens"] for r in whole.collect()) == sorted(r["n_tokens"] for r in packing.pack(docs).collect())
    assert packing.pack(docs, most=1 << 17).select("positions").first()[0][:8] == bytes([0, 0, 0, 0, 1, 0, 0, 0])
    assert packing.op1(none).count() == 0


def test_licences(docs, fixture_rows, none):
    expected = []
    for i, t in fixture_rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, v) for p, v in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        expected.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in places}))))
    got = licences.op4(docs).collect()
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(expected, key=str)
    r = next(r for r in got if r["doc_id"] == 8)
    assert r["base_labels"] == "apache,cc-by,gpl,mit" and "cc-by-nc" not in r["base_labels"] and r["score"] == 1.0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licences.op4(none).count() == 0


def plain_places(rows):
    """What scan() gives, by loops over words."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    count = functools.cache(lambda x: sum(x in w for w in words.values()))
    weight = lambda x: max(0.01, np.log((len(rows) + 1) / (count(x) + 0.5)))
    indexed = []
    for text, key, label in licences.TEMPLATES:
        t = text.split()
        places = sorted((p for p in range(len(t)) if count(t[p])), key=lambda p: (count(t[p]), p))[: licences.INDEXED]
        indexed.append((t, key.split(), label, places))
    known = {t[p] for t, _, _, places in indexed for p in places}
    out = {}
    for i, w in words.items():
        looked = set(sorted(known.intersection(w), key=lambda x: (count(x), x))[: licences.LOOKED_UP])
        found = set()
        for t, key, label, places in indexed:
            k = next(j for j in range(len(t)) if t[j : j + len(key)] == key)
            for start in range(-len(t), len(w)):
                at = lambda j: w[start + j] if 0 <= start + j < len(w) else None
                agree = sum(at(p) == t[p] and t[p] in looked for p in places)
                share = sum(weight(x) for j, x in enumerate(t) if at(j) == x) / sum(map(weight, t))
                if agree >= licences.AGREE and all(at(k + j) == x for j, x in enumerate(key)) and share >= licences.LEAST_SHARE:
                    found.add((label, start))
        out[i] = found
    return out


def test_licence_templates(spark):
    rng = random.Random(5)
    rows = [(i, f"intro {t[0]} outro") for i, t in enumerate(licences.TEMPLATES)]
    rows += [(100, "permission is here granted free of charge"), (101, "mit"), (102, "apache licence"), (103, "mit license " * 40), (105, "General Public License version 3, and more")]
    for i in range(200, 240):  # notices with words changed, dropped or cut off
        w = rng.choice(licences.TEMPLATES)[0].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(["", "other", "word"])
        rows.append((i, " ".join(w[rng.randrange(3) :]) + rng.choice(["", " and " + rng.choice(licences.TEMPLATES)[0]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_words", F.lit("clash")).withColumn("_own", F.lit(1)).withColumn("places", F.lit(2))
    found = licences.scan(frame)
    assert found.columns == ["doc_id", "text", "_words", "_own", "n_words", "places"]
    got = {r["doc_id"]: {(p["label"], p["start"]) for p in r["places"] if not p["base"]} for r in found.collect()}
    assert got == plain_places(rows)
    assert all(t[2] in {label for label, _ in got[i]} for i, t in enumerate(licences.TEMPLATES))
    assert not any(got[i] for i in (100, 101, 102)) and ("gpl-3.0", -1) in got[105]
    base = {r["doc_id"]: r["n_base"] for r in licences.op4(frame).collect()}
    assert base[103] == 40 and base[100] == 0


def test_quality(spark, docs, none):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "and", "of", "word", "then", "clean"]) for _ in range(60)) + "." for _ in range(300)]
    bad = [" | ".join(rng.choice(["x$$", "y###", "zz%%", "q***"]) for _ in range(30)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 300), 0) for i in range(600)] + [(5, None, 0), (None, 1, 0), (7, 1, 0), (99999, 1, 0)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.op7(frame, marks).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["predicted"] == int(r["doc_id"] < 300)
    assert quality.op7(docs, marks.limit(0)).where("score <> 0.5").count() == 0
    assert quality.op7(docs, marks.where("quality = 1")).where("score < 0.9").count() == 0
    assert quality.op7(none, marks).count() == 0
    scored = quality.score(docs, quality.train(frame, marks))
    assert scored.columns == [*(c for c in docs.columns if c != "_score"), "_score"] and scored.count() == docs.count() and scored.where("_score IS NULL").count() == 0


def plain_loss(m, rows, labels):
    """The mean loss with each pair of features multiplied out."""
    total = 0.0
    for x, y in zip(rows, labels):
        z = m.w0 + sum(a * b for a, b in zip(m.w, x))
        z += sum(sum(p * q for p, q in zip(m.v[i], m.v[j])) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        total += math.log1p(math.exp(-z if y else z))
    decay = sum(w * w for w in m.w) + sum(v * v for row in m.v for v in row)
    return total / len(rows) + quality.DECAY / 2 * decay


def test_gradients_are_those_of_the_plain_loss():
    rng = np.random.default_rng(6)
    n = 7
    m = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)) / 2, np.zeros(0), np.ones(0))
    x, y = rng.normal(size=(9, n)), rng.integers(0, 2, 9)
    g0, gw, gv = quality.gradients(m, x, y)

    def slope(put):
        ends = []
        for d in (1e-5, -1e-5):
            other = quality.Machine(m.w0, m.w.copy(), m.v.copy(), m.mean, m.scale)
            put(other, d)
            ends.append(plain_loss(other, x, y))
        return (ends[0] - ends[1]) / 2e-5

    assert g0 == pytest.approx(slope(lambda o, d: setattr(o, "w0", o.w0 + d)), abs=1e-7)
    for i in range(n):
        assert gw[i] == pytest.approx(slope(lambda o, d: o.w.__setitem__(i, o.w[i] + d)), abs=1e-7)
        for f in range(3):
            assert gv[i, f] == pytest.approx(slope(lambda o, d: o.v.__setitem__((i, f), o.v[i, f] + d)), abs=1e-7)


def test_fit_step_by_step():
    """The machine after some epochs by a plain version of the optimiser, number by number, over the features that occur."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(6):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append((at, rng.random(4), rng.normal(size=quality.DENSE)))
    labels = np.array([0, 1, 1, 0, 1, 0], float)
    got = quality.fit(rows, labels, seed=2, epochs=3, batch=4)

    size, k = quality.BUCKETS + quality.DENSE, quality.FACTORS
    on = [*range(12), *range(quality.BUCKETS, size)]
    dense = np.array([r[2] for r in rows])
    mean, scale = dense.mean(0), dense.std(0) + 1e-3
    random_ = np.random.default_rng(2)
    start = random_.normal(0, 0.01, (size, k))
    w0, w, v = math.log(labels.mean() / (1 - labels.mean())), dict.fromkeys(on, 0.0), {(i, f): start[i, f] for i in on for f in range(k)}
    moments = {key: [0.0, 0.0] for key in [*w, *v]}
    xs = []
    for at, values, d in rows:
        x = dict.fromkeys(on, 0.0) | dict(zip(at.tolist(), values.tolist()))
        xs.append(x | {quality.BUCKETS + j: min(5.0, max(-5.0, (d[j] - mean[j]) / scale[j])) for j in range(quality.DENSE)})
    step = 0
    for _ in range(3):
        order = random_.permutation(6)
        for first in (0, 4):
            part, step = order[first : first + 4], step + 1
            gw, gv, g0 = {i: quality.DECAY * w[i] for i in on}, {key: quality.DECAY * x for key, x in v.items()}, 0.0
            for r in part.tolist():
                x = xs[r]
                s = [sum(v[i, f] * x[i] for i in on) for f in range(k)]
                z = w0 + sum(w[i] * x[i] for i in on) + sum(s[f] ** 2 - sum((v[i, f] * x[i]) ** 2 for i in on) for f in range(k)) / 2
                g = (1 / (1 + math.exp(-z)) - labels[r]) / len(part)
                g0 += g
                for i in on:
                    gw[i] += g * x[i]
                    for f in range(k):
                        gv[i, f] += g * x[i] * (s[f] - v[i, f] * x[i])
            w0 -= quality.RATE * g0
            for values, grads in ((w, gw), (v, gv)):
                for key, g in grads.items():
                    a, b = moments[key]
                    a, b = moments[key] = [0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g]
                    values[key] -= quality.RATE * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8)
    assert got.w0 == pytest.approx(w0) and np.allclose([got.w[i] for i in on], [w[i] for i in on], atol=1e-7)
    assert np.allclose([got.v[i, f] for i, f in v], list(v.values()), atol=1e-6)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.DENSE
    m = quality.Machine(0.1, rng.normal(size=size) / 10, rng.normal(size=(size, quality.FACTORS)) / 10, np.zeros(quality.DENSE), np.ones(quality.DENSE))
    at, values, dense = quality.features("some words and some more words", quality.Buckets())
    x = np.zeros(size)
    x[at], x[quality.BUCKETS :] = values, np.clip(dense, -5, 5)
    on = np.flatnonzero(x)
    z = m.w0 + x @ m.w + sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in on for j in on if i < j)
    assert m.score(at, values, dense) == pytest.approx(1 / (1 + np.exp(-z)))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "u\r\nx%0A", "<p>x</p>"), (3, "http://b/", None), (4, "http://b/", ""), (5, "http://c/", "é" * 3000), (None, "http://d/", "<p>x</p>"), (6, "http://d/", "lone"), (6, "http://d/", "lone"), (7, "", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = warc.round_trip(frame, folder=f"file://{tmp_path}/x.mono.warc.gz.d/w").collect()
    best: dict = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, u, h in rows:
        h = h or ""
        response = i == best[h]
        expected.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if response else "revisit", None if response else best[h], u, h.encode() if response else b""))
    assert sorted(((*r[:6], bytes(r[6])) for r in got), key=str) == sorted(expected, key=str)
    import gzip

    for f in tmp_path.glob("x.mono.warc.gz.d/w/*[0-9].warc.gz"):  # each member alone is a record
        whole = f.read_bytes()
        for line in f.with_suffix("").with_suffix(".idx").read_text().splitlines():
            at, n, _ = line.split(" ", 2)
            assert gzip.decompress(whole[int(at) : int(at) + int(n)]).startswith(b"WARC/1.1")
    small = warc.round_trip(frame.where("page_id > 2"), least_bytes=1, folder=f"file://{tmp_path}/s").collect()
    assert {r["page_id"]: r["record_type"] for r in small}[3] == "response"
    assert warc.op9(frame.limit(0)).count() == 0


def test_inflate_in_any_pieces():
    import gzip
    import io

    parts = [warc.record(i, f"http://{i}", b"x" * i * 50, "D", None, False) for i in range(40)]
    for data in (gzip.compress(b"".join(parts)), b"".join(gzip.compress(p) for p in parts)):
        assert list(warc.records(warc.inflated(io.BytesIO(data)))) == parts
    assert list(warc.records(bytes([b]) for b in b"".join(parts[:5]))) == parts[:5]


def test_sharding(docs, fixture_rows, none):
    got = sharding.op10(docs).collect()
    assert len(got) == len(fixture_rows)
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(len(by.get(j, [])) for j in range(40)) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    expected = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in fixture_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    assert sharding.op10(none).count() == 0
    dealt = sharding.deal(docs, 3)
    assert dealt.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    others = [c for c in docs.columns if c != "shard"]
    assert sorted(map(str, dealt.select(*others).collect())) == sorted(map(str, docs.select(*others).collect()))


def test_slots_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_PART", 7)
    got = sharding.deal(spark.range(1000), 5).collect()
    for j in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(200))


def test_communication_matrix():
    rng = random.Random(1)
    rows = [rng.randrange(0, 300) for _ in range(30)]
    m = sharding.communication_matrix(rows, 7, 3)
    assert [sum(r) for r in m] == rows and max(map(sum, zip(*m))) - min(map(sum, zip(*m))) <= 1


class Fixed:
    """Stands for a random number generator that gives one number."""

    def __init__(self, u):
        self.u = u

    def random(self):
        return self.u


@pytest.mark.parametrize("good, bad, draws", [(30, 70, 40), (3, 2, 4), (1, 500, 20), (400, 3, 17), (50, 50, 100), (0, 5, 3)])
def test_draws_follow_the_exact_law(good, bad, draws):
    """Each count is drawn by just the numbers between the exact law's sums, computed with whole numbers."""
    weights = {k: math.comb(good, k) * math.comb(bad, draws - k) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    total, below = sum(weights.values()), 0
    assert total == math.comb(good + bad, draws)
    for k, w in weights.items():
        if w / total > 1e-9:
            assert sharding.hypergeometric(Fixed(below / total + w / total * 0.001), good, bad, draws) == k
            assert sharding.hypergeometric(Fixed((below + w) / total - w / total * 0.001), good, bad, draws) == k
        below += w


def test_draws_of_large_numbers():
    """The middle of the law, and its spread, at sizes where logarithms of factorials lose all digits."""
    good, bad, draws = 25 * 10**9, 975 * 10**9, 120 * 10**6
    mean, spread = draws * 0.025, math.sqrt(draws * 0.025 * 0.975)
    for z, u in ((0, 0.5), (1, 0.841345), (-2, 0.0227501)):
        assert abs(sharding.hypergeometric(Fixed(u), good, bad, draws) - mean - z * spread) < 0.01 * spread + 1


def test_dealing_step_by_step(spark):
    """Shards and slots by a plain version, from the same numbers of rows."""
    import xxhash

    shards, seed, parts = 5, 17, 16
    frame = spark.range(700).repartition(3).withColumn("_uid", F.lit("clash"))
    uid = {r["id"]: r["u"] for r in frame.select("id", F.monotonically_increasing_id().alias("u")).collect()}

    def h(first, u):
        start = xxhash.xxh64_intdigest(first.to_bytes(4, "little"), 42)
        x = xxhash.xxh64_intdigest(u.to_bytes(8, "little"), start)
        return x - 2**64 if x >= 2**63 else x

    by_part: dict = {}
    for i, u in uid.items():
        by_part.setdefault(h(seed, u) % parts, []).append((h(seed + 1, u), u, i))
    matrix = sharding.communication_matrix([len(by_part.get(p, [])) for p in range(parts)], shards, seed)
    shard_of, held = {}, {}
    for p, rows in by_part.items():
        to = [j for j, n in enumerate(matrix[p]) for _ in range(n)]
        for (_, u, i), j in zip(sorted(rows), to):
            shard_of[i] = j
            held.setdefault(j, []).append((h(seed + 2, u), u, i))
    slot_of = {i: n for rows in held.values() for n, (_, _, i) in enumerate(sorted(rows))}
    got = {r["id"]: (r["shard"], r["slot"]) for r in sharding.deal(frame, shards, seed).collect()}
    assert got == {i: (shard_of[i], slot_of[i]) for i in uid}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF).cache()
        assert kept.columns == docs.columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "quality classifier":
            low = {r["doc_id"] for r in quality.op7(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
            assert low and ids == {r["doc_id"] for r in docs.collect()} - low
        if name == "n-gram Jaccard join":
            assert ids == {r["doc_id"] for r in set_join.join(before).where("doc_id = component_id").collect()}
        if name == "benchmark decontamination":
            assert decontaminate.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and last.where("size(ids) <> n_pieces").count() == 0


def test_pipeline_cuts_whole_characters(spark, monkeypatch):
    text = "é" * 200
    rows = [(1, text + "end", 403), (2, "x" + text[:130] + "tail", None)]
    got = {r["doc_id"]: r for r in corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), SF).collect()}
    # within the first text too, each 100 bytes that start later than two bytes in stand earlier
    assert got[2]["text"] == "xtail" and got[2]["n_chars"] == 5 and got[1]["text"].endswith("end")


def test_pipeline_keeps_replacement_characters(spark):
    passage = "".join(chr(0x4E00 + i) for i in range(60))  # 180 bytes
    rows = [(1, passage), (2, "a\ufffdb" + passage + "\ufffd")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got == {1: passage, 2: "a\ufffdb\ufffd"}


def test_runs_are_widened_to_characters():
    data = "aé中b".encode()
    assert suffix_dedup.widened(data, []) == [] and suffix_dedup.widened(data, [(0, 1)]) == [(0, 1)]
    assert suffix_dedup.widened(data, [(2, 4)]) == [(1, 6)] and suffix_dedup.widened(data, [(0, 4), (5, 7)]) == [(0, 7)]


def test_pipeline_drops_only_rows_that_leak(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"] or "") > 60)
    leak = f"before {item} after"
    rows = [(None, leak), (None, "a clean text"), (None, None), (1, leak), (1, "another clean text"), (2, leak), (3, "clean")]
    got = corpus_pipeline.unleaked(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "a clean text"), (None, None), (1, "another clean text"), (3, "clean")], key=str)


@pytest.mark.parametrize("fault", [lambda p: p[:-1], lambda p: b"X" + p[1:]])
def test_warc_reader_checks_payloads(spark, tmp_path, fault):
    payload = b"<p>some page</p>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()

    def read(change):
        whole = warc.record(1, "http://a", payload, digest, None, False)
        data = whole if change is None else whole.replace(payload, change(payload))
        member = gzip.compress(data)
        (tmp_path / "f.warc.gz").write_bytes(member)
        (tmp_path / "f.idx").write_text(f"0 {len(member)} <urn:page:1>\n")
        files = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz", f"file://{tmp_path}/f.idx", 1)], warc.FILES)
        return warc.read_indexed(files).collect()

    assert read(None)[0]["payload_digest"] == digest
    with pytest.raises(Exception, match="differs from its headers"):
        read(fault)


ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), duck(SF), ORACLE[name])
