import random

import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (7, "One TWO three"),
    (8, "The MIT License and the Apache License, CC BY-NC; gnu General\nPublic license"), (9, "é" * 300), (10, "a" * 5000), (11, "ab" * 3000),
    (12, "▁ weird   \x00 tokens 中文 " * 5), (None, "a text without an id " * 12), (None, None), (13, "x" * 99), (14, "x" * 100), (15, "x" * 101),
]


def words(rng, n):
    return " ".join("".join(rng.choice(["tion", "er", "an", "the", "st", "ou", "re", "ing"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def fixture_rows():
    """Texts with copies, near copies, shared passages, nulls, empties, ties and a very long one."""
    rng = random.Random(7)
    rows, base = list(ODD), [words(rng, rng.randrange(5, 120)) for _ in range(25)]
    passage = words(rng, 60)
    n = 100
    for text in base:
        rows.append((n, text))
        n += 1
        for _ in range(rng.randrange(4)):
            w = text.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((n, " ".join(w)))
            n += 1
        if rng.random() < 0.4:
            rows.append((n, words(rng, 30) + " " + passage + " " + words(rng, 30)))
            n += 1
    rows += [(n + i, base[0]) for i in range(20)]
    rows += [(500, words(rng, 9)), (501, words(rng, 9))] + [(600 + i, " ".join("abcdefghij"[: 9 - i % 2])) for i in range(4)]
    rows.append((900, words(rng, 20_000)))
    return rows


#: Names that operators use inside, as columns of the caller's.
CLASHES = "_uid _part _ends _before _in _key _kept _removed _spans _stays _leak _leak_sha _sha _quality _score _text _words _hits _own _base _starts places n_words _row _id bucket_ kind blob item_id rank key n".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, bucket int, _doc int, component_id string, ids int, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    rows = [(i, t, "en", None, None if t is None else len(t), "clash", 1, 2, "clash", 3, *CLASHES) for i, t in fixture_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
