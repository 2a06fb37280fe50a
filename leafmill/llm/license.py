"""Licence scans with a positional index of rare words. DataFrame functions only.

The index holds the postings of the templates' words: template and place in it. Document frequencies of these words over the whole
corpus give inverse document frequencies, and the rarest word of each template's mandatory phrase is its anchor: a text without
it cannot hold the phrase. Each text's licence words are looked up among the anchors, the rarest first, which names the templates
to try and no others. For each of these, every place of the anchor proposes where the template would start; the postings of the
phrase's other words, shifted by their place in the template, are intersected with the proposals, and those where the whole phrase
stands remain. A label's score is the share of its template's words that stand in place with one of them; it counts from
LEAST_SHARE on.

One pass over the texts keeps, for each, the distinct licence words, and their places only where all words of some mandatory or base
phrase are there. Words: after lower-casing A-Z, runs of digits, letters and characters beyond ASCII.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each get their row; a text may hold several
labels; of templates that tie all count; very long texts are scanned whole; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_lower, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base result (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, mandatory phrase and template that holds it (fixed values: words of public licence notices).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "spdx license identifier apache", "spdx license identifier apache 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version"),
    ("gpl", "gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "may be used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons attribution 4 0 international", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
)
#: Share of a template's words that must stand in place besides its mandatory phrase.
LEAST_SHARE = 0.5
_NONE = "array<int>"


def vocabulary() -> list[str]:
    return sorted({w for _, _, template in TEMPLATES for w in template.split()} | {w for phrase, _ in BASE for w in phrase.split()})


def _phrases() -> list[str]:
    return [phrase for _, phrase, _ in TEMPLATES] + [phrase for phrase, _ in BASE]


def _words_of(phrase: str) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(phrase.split())])


def positions(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, held (distinct licence words) and hits (place i and word w of each licence word, where some phrase may stand) of every document."""
    found = documents.select("doc_id", F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    known = F.array(*[F.lit(w) for w in vocabulary()])
    found = found.withColumn("held", F.array_intersect("words", known))
    may = reduce(lambda a, b: a | b, [F.size(F.array_except(_words_of(p), F.col("held"))) == 0 for p in _phrases()])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: F.array_contains(F.col("held"), h["w"]))
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), "held", F.when((F.size("held") > 1) & may, hits).alias("hits"))


def inverse_frequencies(found: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents: log((n + 1) / (k + 1)). One row for each word of the fixed vocabulary comes to the driver."""
    n = found.count()
    counts = {r.w: r.k for r in found.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k")).collect()}
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary()}


def anchor_of(phrase: str, rarity: dict[str, float]) -> tuple[int, str]:
    """Place and word of the rarest word of a phrase, the first of equals."""
    parts = phrase.split()
    i = max(range(len(parts)), key=lambda k: (rarity[parts[k]], -k))
    return i, parts[i]


def index_rows(rarity: dict[str, float]) -> list[tuple]:
    """Anchor, its place in the template, its rarity, label, the phrase's words with their places and the template's, of every template."""
    out = []
    for label, phrase, template in TEMPLATES:
        parts, key = template.split(), phrase.split()
        start = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        at, anchor = anchor_of(phrase, rarity)
        # Rarest first: an intersection that is empty stays so.
        order = sorted(range(start, start + len(key)), key=lambda i: (-rarity[parts[i]], i))
        out.append((anchor, start + at, rarity[anchor], label, [(parts[i], i) for i in order if i != start + at], list(zip(parts, range(len(parts))))))
    return out


def _index(rarity: dict[str, float]) -> Column:
    posting = lambda w, i: F.struct(F.lit(w).alias("w"), F.lit(i).alias("i"))
    row = lambda a, at, idf, label, key, words: F.struct(F.lit(a).alias("anchor"), F.lit(at).alias("at"), F.lit(idf).alias("idf"), F.lit(label).alias("label"), (F.array(*[posting(*x) for x in key]) if key else F.array().cast("array<struct<w:string,i:int>>")).alias("key"), F.array(*[posting(*x) for x in words]).alias("words"))
    return F.array(*[row(*x) for x in index_rows(rarity)])


def _shifted(places: Column, by: Column) -> Column:
    """Where a template would start for its word at place by to stand at each of places."""
    return F.transform(places, lambda p: p - by)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    found = materialize(positions(documents))
    rarity = inverse_frequencies(found)
    none = F.array().cast(_NONE)
    # Each licence word's places, once.
    own = lambda w: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["i"])
    got = found.withColumn("places", F.when(F.col("hits").isNotNull(), F.map_from_entries(F.transform("held", lambda w: F.struct(w, own(w))))))
    of = lambda w: F.coalesce(F.try_element_at("places", w), none)
    got = got.withColumns({f"b{k}": F.when(F.col("hits").isNotNull(), reduce(F.array_intersect, [_shifted(of(F.lit(w)), F.lit(i)) for i, w in enumerate(phrase.split())])).otherwise(none) for k, (phrase, _) in enumerate(BASE)})
    # The templates whose anchor is among the text's licence words, the rarest first.
    tried = F.array_sort(F.filter(_index(rarity), lambda t: F.array_contains(F.col("held"), t["anchor"])), lambda a, b: F.when(a["idf"] > b["idf"], -1).when(a["idf"] < b["idf"], 1).otherwise(0))
    starts = lambda t: F.aggregate(t["key"], _shifted(of(t["anchor"]), t["at"]), lambda acc, k: F.array_intersect(acc, _shifted(of(k["w"]), k["i"])))
    stood = F.filter(F.transform(tried, lambda t: F.struct(t["label"].alias("label"), t["words"].alias("words"), starts(t).alias("starts"))), lambda x: F.size(x["starts"]) > 0)
    share = lambda x: F.size(F.filter(x["words"], lambda k: F.arrays_overlap(x["starts"], _shifted(of(k["w"]), k["i"])))) / F.size(x["words"])
    made = F.filter(F.transform("stood", lambda x: F.struct(share(x).alias("share"), x["label"].alias("label"))), lambda x: x["share"] >= LEAST_SHARE)
    kind = "array<struct<share:double,label:string>>"
    got = got.withColumn("stood", F.when(F.col("hits").isNotNull(), stood))
    got = got.withColumn("made", F.when(F.size("stood") > 0, made).otherwise(F.array().cast(kind)))
    every = F.concat(*[F.col(f"b{k}") for k in range(len(BASE))])
    base = F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    certain = F.when(F.size(every) > 0, F.lit(LEAST_SHARE)).otherwise(F.lit(0.0))
    return got.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("made", lambda x: x["label"]))).alias("labels"),
        F.greatest(certain, F.coalesce(F.array_max(F.transform("made", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
