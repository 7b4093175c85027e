"""License scans by a positional index of rare license words.

Templates are notices and notice lines, each with a mandatory key phrase. The index holds
of each template its INDEXED rarest words over all documents, with the template and the
place in it. Of a file, the LOOKED_UP rarest words that the index has are looked up; word
and posting give the place where the template would begin, and the postings are
intersected by it: AGREE different words must give the same place. There the key phrase
must stand word by word, and the other words are compared by relative position; words
beyond the file's ends count as different. The template's label holds when the share of
matching words, weighted by rarity, reaches LEAST_SHARE.

Base templates are phrases that are their own key phrases: every place of one of their
words is verified, and they count when every word stands.

Everything is an expression over a document's own row: there is no shuffle but that of
the document frequencies of the templates' words. Words are what is left between ASCII
signs and blanks; only ASCII letters decide labels, for which lower() is the same as
lower-casing A-Z. A null text is an empty one: no words, no labels, score 0. Columns of
the input are carried along; ``n_words`` and ``places`` replace columns of these names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested

#: Phrases and labels of the base.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own templates: words, key phrase, label. First lines, then whole notices.
TEMPLATES = [
    ("gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gnu affero general public license", "affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc by nd", "cc-by-nd"),
    ("released under the mit license", "under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify", "isc"),
    ("subject to the terms of the mozilla public license version 2 0", "mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("all rights reserved", "all rights reserved", "proprietary"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge", "mit-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms", "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies",
        "permission to use copy modify", "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied",
        "apache license version 2 0", "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
        "terms of the gnu general public license as published by the free software foundation", "gpl-notice",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "https mozilla org mpl 2 0",
        "mozilla public license", "mpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
        "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software", "unlicense",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "permission is granted to anyone to use this software for any purpose", "zlib",
    ),
]
LEAST_SHARE = 0.7
#: Words of a template in the index; words of a file that are looked up; postings that must agree on a place.
INDEXED, LOOKED_UP, AGREE = 6, 16, 2
#: A place as one number: the template, and where it begins, which may be before the text.
BEFORE = 4096
#: Between words: ASCII without digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEMPLATE = "array<struct<words:array<string>,key:int,n_key:int,label:string,base:boolean,weights:array<double>,total:double>>"


def words_of(text: Column) -> Column:
    """Words, with an empty one in front or at the end where the text does not begin or end in a word."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN)


def template_words() -> list[str]:
    return sorted({w for t in [*BASE, *(t[0] for t in TEMPLATES)] for w in t.split()})


def document_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """How many documents have each template word, and how many there are."""
    known = F.array(*[F.lit(w) for w in template_words()])
    found = docs.select(F.explode(F.concat(F.array_intersect(words_of(F.col("text")), known), F.array(F.lit("")))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}  # as many rows as there are template words
    return {w: counts.get(w, 0) for w in template_words()}, counts.get("", 0)


def index(counts: dict[str, int], total: int) -> tuple[list[dict], dict[str, list[dict]], list[str]]:
    """Templates; postings (template t, place p in it) of each indexed word; the indexed words of the method's own templates, rarest first."""
    templates, postings, own = [], {}, set()
    for text, key, label, base in [*((p, p, v, True) for p, v in BASE.items()), *((*t, False) for t in TEMPLATES)]:
        words, key = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        weights = [max(0.01, math.log((total + 1) / (counts[w] + 0.5))) for w in words]
        templates.append({"words": words, "key": at, "n_key": len(key), "label": label, "base": base, "weights": weights, "total": sum(weights)})
        ranked = sorted((i for i in range(len(words)) if base or counts[words[i]]), key=lambda i: (counts[words[i]], i))
        for i in ranked[: 1 if base else INDEXED]:
            postings.setdefault(words[i], []).append({"t": len(templates) - 1, "p": i, "base": base})
            if not base:
                own.add(words[i])
    return templates, postings, sorted(own, key=lambda w: (counts[w], w))


def scan(docs: DataFrame, counts: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """docs with n_words and ``places``: (label, base, start, share) of each place where a template stands."""
    templates, postings, own = index(*(document_counts(docs) if counts is None else counts))
    table = F.from_json(F.lit(json.dumps(templates)), TEMPLATE)
    posting = F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<t:int,p:int,base:boolean>>>")
    words, hits = F.col("_words"), F.col("_hits")
    indexed = sorted(postings)
    first = F.when(F.element_at(words, 1) == "", 1).otherwise(0)
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    split = docs.select(nested(docs), words_of(F.col("text")).alias("_words"))
    every = F.filter(F.transform(words, lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    rarest = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in own]).cast("array<string>"), words), 1, LOOKED_UP)
    found = split.select(
        "_row", "_words", first.alias("_shift"), (F.size(words) - first - last).cast("long").alias("n_words"),
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in indexed])), F.struct(every.alias("hits"), rarest.alias("rarest"))).alias("_hits"),
    )

    def places_of(base: bool) -> Column:
        """Where templates would begin by each posting of the words looked up, as numbers."""
        used = hits["hits"] if base else F.filter(hits["hits"], lambda h: F.array_contains(hits["rarest"], h["w"]))
        begins = lambda h: F.transform(F.filter(F.try_element_at(posting, h["w"]), lambda p: p["base"] == base), lambda p: p["t"].cast("long") * (1 << 40) + h["i"] - p["p"] + BEFORE)
        return F.flatten(F.transform(used, begins))

    found = found.withColumn("_own", F.array_sort(places_of(False))).withColumn("_base", F.array_distinct(places_of(True)))
    agreed = F.col("_own")
    for _ in range(AGREE - 1):  # each posting of one place is another word of the template
        agreed = F.filter(F.zip_with(agreed, F.slice(agreed, 2, F.size(agreed)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    found = found.withColumn("_starts", F.concat("_base", F.array_distinct(agreed)))

    def place(s: Column) -> Column:
        template, at = F.element_at(table, F.floor(s / (1 << 40)).cast("int") + 1), (s % (1 << 40)).cast("int") - BEFORE
        same = F.transform(template["words"], lambda w, j: F.coalesce(F.get(words, at + j) == w, F.lit(False)))
        weight = F.aggregate(F.zip_with(same, template["weights"], lambda x, w: F.when(x, w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        key = F.forall(F.slice(same, template["key"] + 1, template["n_key"]), lambda x: x)
        share = F.least(F.lit(1.0), weight / template["total"])
        good = key & (share >= F.when(template["base"], 1.0 - 1e-9).otherwise(LEAST_SHARE))
        return F.when(good, F.struct(template["label"].alias("label"), template["base"].alias("base"), (at - F.col("_shift")).cast("long").alias("start"), share.alias("share")))

    places = F.filter(F.transform("_starts", place), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_words", "places")]
    return found.select("_row", "n_words", F.coalesce(places, none).alias("places")).select(*kept, "n_words", "places")


def op4(docs: DataFrame) -> DataFrame:
    """The digest of scan()."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """The rows of op4() as DuckDB SQL: postings joined to words, places counted by joins."""
    words = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    rows = []
    for n, (text, key, label, base) in enumerate([*((p, p, v, "true") for p, v in BASE.items()), *((*t, "false") for t in TEMPLATES)]):
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        rows.append(f"({n}, {words(text)}, {words(key)}, {at}, '{label}', {base})")
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
    t(id, words, key, place, label, base) AS (VALUES {", ".join(rows)}),
    dw AS MATERIALIZED (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d) WHERE x IN ({", ".join(f"'{w}'" for w in template_words())})),
    df AS MATERIALIZED (SELECT x, count(DISTINCT doc_id) AS n FROM dw GROUP BY x),
    m AS (SELECT coalesce(map(list(x), list(n)), map()) AS n FROM df),
    tw AS MATERIALIZED (SELECT t.*, list_transform(t.words, lambda x: greatest(0.01e0, ln((c.total + 1) / (coalesce(m.n[x], 0) + 0.5e0)))) AS weights FROM t, m, (SELECT count(*) AS total FROM documents) c),
    idx AS (SELECT id, p, x FROM (SELECT id, p, x, row_number() OVER (PARTITION BY id ORDER BY n, p) AS r FROM (SELECT id, unnest(range(len(words))) AS p, unnest(words) AS x FROM t WHERE NOT base) JOIN df USING (x)) WHERE r <= {INDEXED}),
    rarest AS (SELECT doc_id, x FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY n, x) AS r FROM (SELECT DISTINCT doc_id, x FROM dw JOIN (SELECT DISTINCT x FROM idx) USING (x)) JOIN df USING (x)) WHERE r <= {LOOKED_UP}),
    own AS (SELECT doc_id, id, i - p AS start FROM dw JOIN rarest USING (doc_id, x) JOIN idx USING (x) GROUP BY doc_id, id, start HAVING count(*) >= {AGREE}),
    base AS (SELECT doc_id, id, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(key)] = key)) AS start FROM d, t WHERE base AND list_contains(w, key[1])),
    starts AS (SELECT * FROM own UNION ALL SELECT * FROM base),
    places AS (SELECT s.doc_id, tw.label, tw.base, start, least(1e0, list_sum(list_transform(range(len(words)), lambda j: CASE WHEN start + j >= 0 AND w[start + j + 1] = words[j + 1] THEN weights[j + 1] ELSE 0e0 END)) / list_sum(weights)) AS share
        FROM starts s JOIN tw USING (id) JOIN d ON s.doc_id = d.doc_id WHERE start + place >= 0 AND w[start + place + 1 : start + place + len(key)] = key),
    good AS (SELECT * FROM places WHERE base OR share >= {LEAST_SHARE})
    SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(g.start) FILTER (g.base) AS n_base, min(g.start) FILTER (g.base) AS first_word, max(g.start) FILTER (g.base) AS last_word,
        coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label) FILTER (g.base), '') AS base_labels, coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label), '') AS labels,
        round(coalesce(max(g.share), 0e0), 6) AS score
    FROM d LEFT JOIN good g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""
