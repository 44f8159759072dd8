"""Licence scan by a positional index of rare words, with DataFrame functions alone.

Base: places where a phrase's words stand one after the other. Method: each licence template is a fixed
text; the index has, for each word, its templates and relative positions. A word's IDF comes from the
document frequencies of the whole table. A file looks up its RAREST licence words of the highest IDF, no
others, and every (template, file position - template position) that their postings agree on is a hit of
that alignment. Its strength is the IDF weight of its different looked-up words; an alignment counts with
LEAST such words and SHARE of the weight of the template's own RAREST words or of the file's looked-up words
that the template has, whichever is less. It is verified by the template's mandatory phrases, all of which
must stand in the file, each within SPREAD words of the place that the alignment gives it. The score is the
best verified alignment's share, or 1 for a base phrase.

The template table is a fixed list of this module, so what is broadcast has a fixed size. The texts are read
once: words are counted, licence words found, and the words of files that hold every word of a template's
mandatory phrases or of a base phrase are written; all else reads what was written. Frequencies are combined
before the shuffle, and each file's work stays in its row.

Defined results: a null text is empty and has 0 words; without places first_word and last_word are null;
labels are distinct, in code-point order, and '' if there are none; words of equal IDF are looked up in
code-point order; rows that repeat are rows of their own; extra columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's phrases and labels: fixed values.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Public licence texts, lower-cased words alone, and the phrases that a file of that licence must hold: fixed values.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["except in compliance with the license", "unless required by applicable law"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without"
        " even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["free software foundation", "at your option any later version"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source"
        " code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
        ["for any purpose with or without fee is hereby granted", "the author disclaims all warranties"],
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["source code form is subject to the terms", "mozilla public license"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in"
        " source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software", "released into the public domain"],
    ),
    ("cc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit creativecommons org", ["creative commons attribution"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["licensed under the gnu general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["licensed under the apache license"]),
    ("mit", "released under the mit license", ["released under the mit license"]),
    ("cc", "licensed under cc by nc 4 0", ["licensed under cc by"]),
]
#: Licence words of the highest IDF that a file looks up, and the words and share of weight that an alignment needs.
RAREST, LEAST, SHARE = 24, 3, 0.5
#: Words by which a mandatory phrase may stand off the place that an alignment gives it.
SPREAD = 8


def _of(value: Column, make) -> Column:
    """make(x) where x is value, evaluated once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, null as empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def places(found: Column, phrase: str) -> Column:
    """The starts of a phrase in an array of words, overlapping ones too."""
    parts = phrase.split()
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - len(parts), F.lit(0))), lambda i: _all([F.get(found, i + k) == w for k, w in enumerate(parts)]))
    return F.when(F.arrays_overlap(found, F.array(F.lit(parts[0]))), starts).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _best(template: int, near) -> Column:
    """The weight of the template's best alignment among the shifts that near allows: its different words.

    Hits stand in order of shift and word, so one pass adds them up run by run.
    """
    own = F.filter("hits", lambda h: (h["t"] == template) & near(h["shift"]))
    own = F.array_sort(F.transform(own, lambda h: F.struct(h["shift"].alias("shift"), h["word"].alias("word"), h["w"].alias("w"))))
    none = F.struct(F.lit(None).cast("int").alias("shift"), F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def add(acc, h):
        same = acc["shift"].eqNullSafe(h["shift"])
        new = ~(same & (acc["word"] == h["word"]))
        n = F.when(same, acc["n"]).otherwise(0) + new.cast("int")
        total = F.when(same, acc["sum"]).otherwise(0.0) + F.when(new, h["w"]).otherwise(0.0)
        return F.struct(h["shift"].alias("shift"), h["word"].alias("word"), n.alias("n"), total.alias("sum"), F.greatest(acc["best"], F.when(n >= LEAST, total).otherwise(0.0)).alias("best"))

    return F.aggregate(own, none, add, lambda acc: acc["best"])


def _weight_of(own: list[str], weight: Column) -> Column:
    """The weight of a template's words among those that the file looked up."""
    return F.aggregate(F.filter("lookup", lambda w: w.isin(*own)), F.lit(0.0), lambda a, w: a + F.element_at(weight, w))


def _near(place_of: dict[str, Column], offset: dict[str, int]):
    """shift -> whether every phrase stands about where the alignment has it."""

    def one(phrase, s):
        return F.exists(place_of[phrase], lambda i: F.abs(i - s - offset[phrase]) <= SPREAD)

    return lambda s: _all([one(p, s) for p in place_of])


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of df."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    known = F.lit(vocabulary).cast("array<string>")
    # files that can hold a base phrase or all phrases that a template needs
    needs = [sorted(set(p.split())) for p in PHRASES.values()] + [sorted({w for p in ps for w in p.split()}) for _, _, ps in TEMPLATES]
    needs = [n for n in needs if not any(set(m) < set(n) for m in needs)]
    may = lambda has: _any([F.size(F.array_intersect(has, F.lit(n).cast("array<string>"))) == len(n) for n in needs])
    each = _of(words(F.col(text)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.array_intersect(known, ws).alias("known"), ws.alias("ws")))
    d = df.select(F.col(key).alias("doc_id"), each.alias("x")).select("doc_id", "x.n_words", "x.known", F.when(may(F.col("x.known")), F.col("x.ws")).alias("words"))
    d = stored(d, "licence-words")
    counts = {r["word"]: r["df"] for r in d.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # a row for each word of the fixed templates
    total = d.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
    # the index: word -> (template, relative position), rarest words first
    postings: dict[str, list[dict]] = {}
    for t, (_, template, _) in enumerate(TEMPLATES):
        for at, w in enumerate(template.split()):
            postings.setdefault(w, []).append({"t": t, "at": at})
    rare_first = sorted(vocabulary, key=lambda w: (-idf[w], w))
    literal = lambda m, kind: F.from_json(F.lit(json.dumps(m)), kind)
    index, weight = literal(postings, "map<string,array<struct<t:int,at:int>>>"), literal(idf, "map<string,double>")
    hit = d.where("words is not null").select("doc_id", "n_words", "words", F.slice(F.array_intersect(F.lit(rare_first).cast("array<string>"), F.col("known")), 1, rarest).alias("lookup"))
    at = F.filter(F.transform(F.col("words"), lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: F.array_contains(F.col("lookup"), x["word"]))
    hits = F.flatten(F.transform(at, lambda x: F.transform(F.element_at(index, x["word"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("shift"), x["word"].alias("word"), F.element_at(weight, x["word"]).alias("w")))))
    names = sorted({p for _, _, ps in TEMPLATES for p in ps} | set(PHRASES.values()))
    hit = hit.withColumn("hits", hits).withColumns({f"at{i}": places(F.col("words"), p) for i, p in enumerate(names)})
    # a written table: lambdas below read columns, where a merged plan would redo hits and places for each element
    hit = stored(hit, "licence-hits")
    place_of = {p: F.col(f"at{i}") for i, p in enumerate(names)}
    best = []
    for t, (_, template, phrases) in enumerate(TEMPLATES):
        own = set(template.split())
        top = sum(sorted((idf[w] for w in own), reverse=True)[:rarest])
        looked = _weight_of(sorted(own), weight)
        expected = F.greatest(F.least(F.lit(top), looked), F.lit(1e-9))
        spot = {p: f" {template} ".index(f" {p} ") for p in phrases}
        offset = {p: len(template[: max(s, 0)].split()) for p, s in spot.items()}
        near = _near({p: place_of[p] for p in phrases}, offset)
        held = _all([F.size(place_of[p]) > 0 for p in phrases])
        best.append(F.when(held, F.least(_best(t, near) / expected, F.lit(1.0))).otherwise(0.0))
    hit = hit.withColumn("best", F.array(*best))
    base = {label: place_of[p] for label, p in PHRASES.items()}
    every = F.concat(*base.values())
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, label) for label, c in base.items()]))
    found = F.array_compact(F.array(*[F.when(F.get("best", F.lit(t)) >= share, label) for t, (label, _, _) in enumerate(TEMPLATES)]))
    hit = hit.select(
        "doc_id", "n_words",
        F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, found))), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.filter("best", lambda b: b >= share)), F.lit(0.0))).alias("score"),
    )
    none = F.lit(None).cast("long")
    rest = d.where("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return hit.unionByName(rest)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op6_licences": op6_licences}
ORACLES: dict[str, str] = {}
