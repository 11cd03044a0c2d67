"""Licence scan with a positional index of rare words.

Templates and phrases are word sequences. The index keeps, for every template, the positions of
its words that are rarest in the corpus; a file's licence words are looked up there, a posting and a
word's place give the place where the template would start, and places on which enough rare words agree are
verified: the mandatory key phrase must stand there word for word. Only column expressions are used.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label to phrase: the base labels (fixed values).
BASE_PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}


@dataclass(frozen=True)
class Template:
    """`key` must stand word for word within `text`; its rare words must agree on the place."""

    label: str
    text: str
    key: str


#: Passages of common licences, in the licences' own words (fixed values): label, words, key phrase. A long licence has several
#: windows, so that a word that is put in or left out costs it one of them.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
     "copies of the software", "to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-release", "released under the mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
     "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
     "may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
     "anyone is free to copy modify publish use compile sell or distribute"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
     "in no event will the authors be held liable for any damages"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "you may not use this file except in compliance with the license"),
    ("gpl-work", "this work is licensed under the gnu general public license", "licensed under the gnu general public license"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license version 3", "gnu affero general public license"),
    ("gpl", "gnu gpl v3", "gnu gpl v3"), ("gpl", "gnu gpl v2", "gnu gpl v2"), ("gpl", "gnu gpl version", "gnu gpl version"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial"),
    ("cc-by-nc", "cc by nc 4 0", "cc by nc"), ("cc-by-sa", "cc by sa 4 0", "cc by sa"), ("cc-by-nd", "cc by nd 4 0", "cc by nd"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
)
#: Short identifiers that may follow the words of an identifier line (fixed values), and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2.0", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 2 0": "mpl-2.0",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3-clause", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib", "cc0 1 0": "cc0", "cc by 4 0": "cc-by",
}
TEMPLATES = tuple(Template(*p) for p in PASSAGES) + tuple(
    Template(label, f"spdx license identifier {name}", f"spdx license identifier {name}") for name, label in IDENTIFIERS.items()
)

#: Rare words of a template that are indexed, and the share of them that must agree on a place.
RARE_WORDS = 4
MIN_AGREEMENT = 0.75

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: str) -> list[str]:
    return re.findall(WORD, text)


def words_of(text: Column) -> Column:
    """The words of a text in lower case.

    Lower-casing letters beyond A-Z too is cheaper and moves no word's start or end; no phrase or template has a
    letter that another alphabet's capital turns into, but for the Kelvin sign, which reads as a k.
    """
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)
    lead = (F.element_at(parts, 1) == "").cast("int")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - tail)


def vocabulary(templates: tuple[Template, ...], phrases: dict[str, str]) -> list[str]:
    return sorted({w for t in templates for w in split_words(t.text)} | {w for p in phrases.values() for w in split_words(p)})


def document_frequency(words: DataFrame, vocab: list[str]) -> tuple[int, dict[str, int]]:
    """Documents in all, and documents per licence word; at most one row per word of the vocabulary comes back."""
    seen = words.select(F.explode(F.array_append(F.array_intersect(F.col("words"), _literal(vocab)), F.lit(""))).alias("w"))
    counts = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    return counts.pop("", 0), counts


def rarest(words: list[str], counts: dict[str, int], n: int) -> list[int]:
    """Places of the n words with the highest inverse document frequency, each word once, ties by place."""
    places = {w: i for i, w in reversed(list(enumerate(words)))}
    return sorted(sorted(places.values(), key=lambda i: (counts.get(words[i], 0), i))[:n])


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _constant(value: object, kind: str) -> Column:
    """A constant of a nested type; it is read once, when the plan is made."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


@dataclass(frozen=True)
class Index:
    """Entries by number (phrases first, then templates) and, by rare word, the entries and places where it stands in them."""

    labels: list[str]
    words: list[list[str]]
    keys: list[list[str]]
    offsets: list[int]
    needed: list[int]
    postings: dict[str, list[dict[str, int]]]
    phrases: int


def build_index(templates: tuple[Template, ...], phrases: dict[str, str], counts: dict[str, int]) -> Index:
    """Of a phrase its rarest word is indexed, of a template its RARE_WORDS rarest, MIN_AGREEMENT of which must agree on a place."""
    entries = [(label, split_words(p), split_words(p), 1) for label, p in phrases.items()]
    entries += [(t.label, split_words(t.text), split_words(t.key), RARE_WORDS) for t in templates]
    out = Index([], [], [], [], [], {}, len(phrases))
    for number, (label, words, key, rare) in enumerate(entries):
        places = rarest(words, counts, rare)
        out.labels.append(label), out.words.append(words), out.keys.append(key)
        out.offsets.append(next(i for i in range(len(words)) if words[i:i + len(key)] == key))
        out.needed.append(max(1, -int(-MIN_AGREEMENT * len(places) // 1)))
        for i in places:
            out.postings.setdefault(words[i], []).append({"t": number, "p": i})
    return out


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, base (places and labels of phrases), found (places and labels of templates), best (share of agreeing template words).

    `base` holds every place where a phrase's words stand consecutively; `found` the places of templates.
    A null text counts as empty and gives no words and no places. Repeated rows give repeated rows,
    an empty table an empty result, and extra columns are ignored. Ties among equally rare words go to the earlier place.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    _, counts = document_frequency(rows, vocabulary(templates, phrases))
    index = build_index(templates, phrases, counts)
    hit = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(sorted(index.postings)), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull(),
    )
    postings = _constant(index.postings, "map<string,array<struct<t:int,p:int>>>")
    needed, offsets = _constant(index.needed, "array<int>"), _constant(index.offsets, "array<int>")
    keys, seqs, labels = _constant(index.keys, "array<array<string>>"), _constant(index.words, "array<array<string>>"), _constant(index.labels, "array<string>")
    words = F.col("words")
    # A word at a place votes for the entries it stands in, each at the place where the entry would start.
    votes = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(postings[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("s"))))))
    rows = rows.withColumn("hits", hit).withColumn("votes", F.when(F.size("hits") > 0, votes).otherwise(F.array().cast("array<struct<t:int,s:int>>")))
    # Equal votes are neighbours, so enough of them begin where the vote some places on is the same.
    agreed = F.array_distinct(F.filter(F.transform("votes", lambda v, i: F.when(F.get("votes", i + F.get(needed, v["t"]) - 1) == v, v)), lambda v: v.isNotNull()))

    def stands(v: Column) -> Column:
        start, key = v["s"] + F.get(offsets, v["t"]), F.get(keys, v["t"])
        return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(key)) == key)

    def share(v: Column) -> Column:
        seq = F.get(seqs, v["t"])
        there = F.transform(seq, lambda w, i: (v["s"] + i >= 0) & F.coalesce(F.get(words, v["s"] + i) == w, F.lit(False)))
        return F.size(F.filter(there, lambda x: x)) / F.size(seq).cast("double")

    # A template's opening words may stand before the text begins; only its key phrase must be there.
    rows = rows.withColumn("sure", F.when(F.size("votes") > 0, F.filter(agreed, stands)).otherwise(F.col("votes")))
    place = lambda v: F.struct(v["s"].alias("start"), F.get(labels, v["t"]).alias("label"))
    phrase = lambda v: v["t"] < index.phrases
    found = F.filter("sure", lambda v: ~phrase(v))
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.array_sort(F.transform(F.filter("sure", phrase), place)).alias("base"), F.array_sort(F.transform(found, place)).alias("found"),
        F.coalesce(F.array_max(F.transform(found, share)), F.lit(0.0)).alias("best"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The scan's places as counts, first and last place, and labels."""
    starts = F.transform("base", lambda b: b["start"])
    base, more = F.transform("base", lambda b: b["label"]), F.transform("found", lambda b: b["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.col("best")).alias("score"),
    )
