"""Set join, suffix dedup, decontamination and fingerprints against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, edit_embedding, graph, set_join, suffix_dedup


def shingle_sets(rows, k):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def components(rows, k, share):
    sets = shingle_sets(rows, k)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if share[1] * len(s & t) >= share[0] * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    links = lambda s: sum(bool(t) and share[1] * len(s & t) >= share[0] * len(s | t) for _, t in known) - 1 if s else 0
    return sorted(((i, len(s), None if i is None else find(i), None if i is None else links(s)) for i, s in sets), key=str)


def rows_of(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("k", "share", "long_list"), [(4, (85, 100), 4096), (5, (80, 100), 2), (2, (60, 100), 4096)])
def test_set_join(spark, docs, fixture_rows, monkeypatch, k, share, long_list):
    monkeypatch.setattr(set_join, "LONG_LIST", long_list)
    monkeypatch.setattr(set_join, "BLOCK", 300 if long_list == 2 else set_join.BLOCK)
    assert rows_of(set_join.join(docs, k, share)) == components(fixture_rows, k, share)


@pytest.mark.parametrize("share", [(80, 100), (45, 100)])
def test_long_lists_are_split(spark, monkeypatch, share):
    """One shingle is in every prefix: the list of it is keyed anew and dealt into blocks, and no link is lost."""
    monkeypatch.setattr(set_join, "LONG_LIST", 8)
    monkeypatch.setattr(set_join, "LARGEST_LIGHT", 0)
    monkeypatch.setattr(set_join, "counters", lambda docs, words: np.zeros(1 << 20, np.uint8))  # order by hash alone
    rng = random.Random(8)
    rows, base = [], [[f"w{rng.randrange(60)}" for _ in range(12)] for _ in range(12)]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(12)] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(sorted({"common", "also", "too", *w}))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(set_join.join(frame, 1, share)) == components(rows, 1, share)


def test_set_join_of_nothing(none):
    assert set_join.op2(none).count() == 0


def test_light_sets_meet_by_subsets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sorted(rng.sample("abcdefghijk", rng.randrange(1, 9)), key="abcdefghijk".index))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    share = (70, 100)
    assert set_join.boundary({n: 1000 for n in range(1, 4)}, share) >= 3
    assert rows_of(set_join.join(frame, 1, share)) == components(rows, 1, share)


def test_representatives(spark, docs, fixture_rows):
    expected = {i for i, _, c, _ in components(fixture_rows, 5, (80, 100)) if i is not None and i == c}
    got = set_join.representatives(docs.union(docs.where("doc_id = 100")))
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect() if r["doc_id"] is not None} == expected
    assert got.where("doc_id = 100").count() == 1 and got.where("doc_id IS NULL").count() == 2
    rows = [(1, "a b c d e f", "en", 1), (1, "a b c d e f", "de", 2), (1, "x y z", "en", 3), (2, "a b c d e f", "en", 4), (3, None, "en", 5), (3, None, "fr", 6), (None, "a b c d e f", "en", 7)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, _row string, _stays long").withColumn("_id", F.lit("clash"))
    got = set_join.representatives(clash)
    assert got.columns == clash.columns and sorted((r["doc_id"], r["text"]) for r in got.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()) == [(1, "a b c d e f"), (1, "x y z")]
    assert got.where("doc_id = 3").count() == 1 and got.where("doc_id IS NULL").count() == 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(80)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["id"]: r["component"] for r in graph.components(frame).collect()}
    nodes, low = graph.roots(*map(np.array, zip(*[e for e in edges if e[0] != e[1]])))
    assert got == dict(zip(nodes.tolist(), low.tolist()))
    assert graph.components(frame.limit(0)).count() == 0


def cut(rows):
    seen, out = {}, {}
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0))
    for n, (i, t) in order:
        data, covered = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.setdefault(w, (i, p))
        runs = sum(1 for p in range(len(covered)) if covered[p] and (p == 0 or not covered[p - 1]))
        out[n] = (i, len(data), sum(covered), runs, hashlib.sha256(bytes(c for c, x in zip(data, covered) if not x)).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("hot, bucket", [(False, 64 << 20), (True, 64 << 20), (False, 9000), (True, 9000)])
def test_suffix_dedup(docs, fixture_rows, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10_000)
    got = suffix_dedup.op5(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == cut(fixture_rows)


def test_rows_without_an_id_are_dealt(spark, fixture_rows):
    rows = [(None if n % 3 == 0 else i, t) for n, (i, t) in enumerate(fixture_rows) if len(t or "") < 5000]
    rows = [(i, t) for n, (i, t) in enumerate(rows) if i is not None or t not in [x for j, x in rows[:n] if j is None]]
    known = [r for r in rows if r[0] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.coalesce("doc_id", F.lit(suffix_dedup.LAST_ID)))
    assert frame.where("doc_id IS NULL").select(suffix_dedup.doc_bucket_column(8).alias("b")).distinct().count() > 4
    got = suffix_dedup.op5(frame).where("doc_id IS NOT NULL").collect()  # ids that are null come last
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == cut(known)


def test_suffix_dedup_keeps_columns(docs, none):
    got = suffix_dedup.dedupe(docs)
    others = [c for c in docs.columns if c not in ("_kept", "_removed", "_spans")]
    assert got.columns == [*others, "_kept", "_removed", "_spans"]
    assert sorted(map(str, got.select(*others).collect())) == sorted(map(str, docs.select(*others).collect()))
    assert suffix_dedup.op5(none).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcd ") for _ in range(2000)) for _ in range(2))
    rows = [(1, a + b), (2, "zz" + a[500:1500] + "yy" + b[100:350]), (3, b[:99] + "!" + b[99:250]), (4, "q" * 1000)]
    got = suffix_dedup.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == cut(rows)


@pytest.mark.parametrize("alphabet", [2, 5, 256])
def test_deep_shallow_sort(alphabet):
    rng = np.random.default_rng(alphabet)
    rows = rng.integers(0, alphabet, (400, 80), dtype=np.uint8)
    for i in range(0, 400, 3):  # long common prefixes and equal rows
        rows[i] = rows[rng.integers(400)]
        rows[i, rng.integers(30, 80) :] = rng.integers(0, alphabet)
    rows[:50] = rows[50]
    order, lcp = suffix_dedup.deep_shallow_sort(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(r.tobytes() for r in rows)
    common = lambda a, b: next((k for k in range(80) if a[k] != b[k]), 80)
    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(texts, texts[1:])]


def edits(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 160)))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny bit"), (53, "tiny bit")]
    texts = []
    for n in range(60):
        i = rng.randrange(12)
        x = list(decontaminate.normal(items[i][1]))
        for _ in range(rng.randrange(0, len(x) // 12)):
            x[rng.randrange(len(x))] = rng.choice("abcXY")
        texts.append((n, "lead words " * rng.randrange(4) + "".join(x).upper().replace(" ", " \n") + " and more" * rng.randrange(4)))
    texts += [(100, None), (101, ""), (102, "a TINY\tbit of it"), (None, items[0][1])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, t in texts:
        for i, x in items:
            x = decontaminate.normal(x)
            if x and (len(x) >= decontaminate.Q and edits(x, decontaminate.normal(t)) <= decontaminate.budget(len(x)) or len(x) < decontaminate.Q and x in decontaminate.normal(t)):
                expected.add((d, i))
    for block in (4_000_000, 800):
        decontaminate.BLOCK = block
        got = decontaminate.contamination(frame, bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    decontaminate.BLOCK = 4_000_000
    assert decontaminate.op6(none, bench).count() == 0 and decontaminate.op6(docs, bench.limit(0)).count() == 0
    assert decontaminate.op6(docs, bench.where("item_id < 50")).count() == 0


def test_contamination_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 150)
    rng = random.Random(4)
    index = decontaminate.Index.of([(1, "".join(rng.choice("abcdef") for _ in range(90)))])
    for at in range(0, 400, 7):
        text = "x" * at + index.texts[0] + "y" * (500 - at)
        found = decontaminate.leaks(text, index)
        assert [(f[0], f[1], f[2], f[3]) for f in found] == [(0, 0, at, 90)]


@pytest.mark.parametrize("piece, expanded, widest", [(1 << 16, 1 << 20, 1 << 16), (40, 7, 30)])
def test_contamination_of_repetitive_text(monkeypatch, piece, expanded, widest):
    for name, value in (("PIECE", piece), ("EXPANDED", expanded), ("WIDEST", widest)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(12)
    unit = ["=", "-", "ab", "abc ", "=-", "aab"]
    texts = ["".join(rng.choice(unit) * rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    items = [(i, t) for i, t in enumerate(["=" * 60, "ab" * 35, "abc " * 20, "=" * 30 + "-" * 30, "x" + "a" * 50, "=", "ab", "-=-"] + texts[:5])]
    index = decontaminate.Index.of(items)
    for text in map(decontaminate.normal, texts):
        got = {i: (d, text[s : s + n], places) for i, d, s, n, places in decontaminate.leaks(text, index)}
        for i, x in items:
            x = decontaminate.normal(x)
            d = edits(x, text)
            assert (i in got) == (d <= decontaminate.budget(len(x)) if len(x) >= decontaminate.Q else d == 0)
            if i in got:
                assert got[i][0] == d == edits(x, got[i][1]) and got[i][2] >= 1


def test_long_runs_of_one_character():
    index = decontaminate.Index.of([(1, "=" * 300), (2, "some other words that are long enough " * 3)])
    began = time.process_time()
    assert [f[:2] for f in decontaminate.leaks("=" * 200_000 + " tail", index)] == [(0, 0)]
    assert decontaminate.leaks("-" * 200_000, index) == []
    assert time.process_time() - began < 30
    three = ("words before " + "=" * 400 + " and so many words after it ") * 3
    assert decontaminate.leaks(three, index) == [(0, 0, 13, 300, 3)]


def test_fingerprints_by_next_document(docs, fixture_rows):
    got = edit_embedding.op8(docs).collect()
    assert len(got) == len(fixture_rows)
    known = sorted(((i, t or "") for i, t in fixture_rows if i is not None), reverse=True)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    walk = edit_embedding.Walk()
    for (i, t), (_, following) in zip(known, known[1:]):
        new = edit_embedding.edited(t, following)
        own, other, after = edit_embedding.fingerprints([t, new, following], walk)
        r = by[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
        assert r["near_edited"] == walk.likeness(own, other) and r["near_next"] == walk.likeness(own, after)
        assert 0 <= r["near_edited"] <= 1


def test_one_document_is_its_own_next(spark, none):
    r = edit_embedding.op8(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    assert edit_embedding.op8(none).count() == 0


def test_walks_alike_in_step_and_alone(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcde é中") for _ in range(rng.randrange(0, 400))) for _ in range(150)]
    walk = edit_embedding.Walk()
    first = edit_embedding.fingerprints(texts, walk)
    monkeypatch.setattr(edit_embedding, "WIDE", 10**9)
    assert edit_embedding.fingerprints(texts, walk) == first


def test_likeness_falls_with_edits(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    walk = edit_embedding.Walk()

    def near(k):
        x = list(text)
        for _ in range(k):
            x.insert(rng.randrange(len(x)), "#")
        return walk.likeness(*edit_embedding.fingerprints([text, "".join(x)], walk))

    assert near(0) == 1.0 and near(3) > 0.7 and walk.likeness(*edit_embedding.fingerprints([text, text[::-1]], walk)) < 0.3
    other = text[:700] + "#" * 12 + text[700:]
    rows = [(i, text) for i in range(3)] + [(10, other), (11, text[::-1]), (12, None), (None, text)]
    pairs = edit_embedding.near_pairs(edit_embedding.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), least=0.3).collect()
    assert sorted((r["doc_id"], r["other_id"]) for r in pairs) == [(1, 0), (2, 0), (10, 0)]


def near_texts(rng, n, least, most):
    """n texts, one in four of them an earlier one with one or two characters replaced."""
    texts = []
    while len(texts) < n:
        if texts and rng.random() < 0.25:
            x = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 3)):
                x[rng.randrange(len(x))] = rng.choice("#$%&")
            texts.append("".join(x))
        else:
            texts.append("".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(least, most))))
    return texts


def recall_of_pairs(spark, texts, least):
    """Share of all near pairs of classes, by brute force, that near_pairs() finds; what it finds is checked."""
    walk = edit_embedding.Walk()
    prints = edit_embedding.fingerprints(texts, walk)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    ids = np.array(list(first.values()))
    near = walk.likenesses(list(first), list(first))
    want = {(int(max(ids[r], ids[c])), int(min(ids[r], ids[c]))): near[r, c] for r, c in zip(*np.nonzero(np.triu(near >= least, 1)))}
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = {(r["doc_id"], r["other_id"]): r["near"] for r in edit_embedding.near_pairs(df, least=least).collect()}
    known = set(ids.tolist())
    assert all(want[k] == v for k, v in got.items() if known.issuperset(k))
    return len(want), len(want.keys() & got.keys()) / len(want)


def test_likenesses_of_many(spark):
    rng = random.Random(5)
    walk = edit_embedding.Walk()
    prints = edit_embedding.fingerprints(["", "a", "b"] + near_texts(rng, 40, 1, 900), walk)
    assert walk.likenesses(prints, prints[::-1]).tolist() == [[walk.likeness(a, b) for b in prints[::-1]] for a in prints]


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    n, recall = recall_of_pairs(spark, texts := near_texts(random.Random(6), 6000, 300, 480), 0.8)
    assert n > 500 and recall > 0.99
    monkeypatch.setattr(edit_embedding, "BLOCK", 3)
    assert recall_of_pairs(spark, texts[:2000], 0.8)[1] > 0.99


def test_pairs_on_either_side_of_a_level(spark):
    rng, walk, texts = random.Random(8), edit_embedding.Walk(), []
    for edge in (64, 128, 1024, 4096, 8192):
        for _ in range(6):
            long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(edge))
            ends = walk.ends([edit_embedding.classes_of(long)], [0])[0]
            n = int(np.searchsorted(ends, edge))  # n characters end before the edge, one more beyond it
            texts += [long[:n], long[: n + 1]]
    n, recall = recall_of_pairs(spark, texts, 0.8)
    assert n >= len(texts) // 2 and recall == 1.0


@pytest.mark.parametrize("least, most", [(1, 9), (8, 32)])
def test_pairs_of_short_texts(spark, least, most):
    n, recall = recall_of_pairs(spark, near_texts(random.Random(9), 3000, least, most), 0.8)
    assert n > 300 and recall > 0.99
