"""Licence scan with a positional index of rare words.

The mandatory phrases of all licence templates make one index: of each phrase, the words that are rarest over all
documents (by inverse document frequency) have postings, (phrase, place in it). A text looks up the words it shares
with the index; every posting, its place in the text less its place in the phrase, votes for a start. Where all rare words of
a phrase vote for one start, the words there are compared with the phrase. So the work is that of the postings
looked up, however many templates there are. A template is found when all of its mandatory phrases are.

Defined cases: a null or empty text has no words, no labels and score 0; rows are scanned each, so
repeated rows give repeated results; only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.stages import evaluated

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare words of a phrase that must agree before it is compared.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    label: str
    phrases: tuple[str, ...]
    base: bool = False


# Base phrases.
BASE = (
    Template("mit", ("mit license",), True),
    Template("apache", ("apache license",), True),
    Template("gpl", ("general public license",), True),
)
# Key phrases of public licence texts and notices.
TEMPLATES = BASE + (
    Template("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind")),
    Template("apache", ("you may not use this file except in compliance with the license",)),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("gpl", ("redistribute it and or modify it under the terms of the gnu general public license",)),
    Template("gpl-2", ("gnu general public license version 2",)),
    Template("gpl-3", ("gnu general public license version 3",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("bsd", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd", ("bsd license",)),
    Template("mpl", ("mozilla public license",)),
    Template("epl", ("eclipse public license",)),
    Template("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    Template("unlicense", ("this is free and unencumbered software released into the public domain",)),
    Template("cc0", ("cc0 1 0 universal",)),
    Template("cc-by", ("licensed under cc by 4 0",)),
    Template("cc-by-sa", ("licensed under cc by sa",)),
    Template("cc-by-nc", ("licensed under cc by nc",)),
    Template("cc-by-nc", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", ("licensed under cc by nd",)),
    Template("cc-by-sa", ("creative commons attribution sharealike",)),
    Template("cc-by", ("creative commons attribution license",)),
    Template("cc-by", ("creative commons attribution 4 0 international",)),
    Template("proprietary", ("all rights reserved",)),
    Template("bsd-3", ("redistribution and use in source and binary forms", "neither the name of the")),
    Template("zlib", ("altered source versions must be plainly marked as such",)),
    Template("bsl", ("boost software license",)),
    Template("artistic", ("artistic license",)),
    Template("afl", ("academic free license",)),
    Template("osl", ("open software license",)),
    Template("ofl", ("sil open font license",)),
    Template("psf", ("python software foundation license",)),
    Template("postgresql", ("postgresql license",)),
    Template("php", ("php license",)),
    Template("odbl", ("open database license",)),
    Template("gfdl", ("gnu free documentation license",)),
    Template("cddl", ("common development and distribution license",)),
    Template("cpl", ("common public license",)),
    Template("eupl", ("european union public licence",)),
    Template("ms-pl", ("microsoft public license",)),
    Template("upl", ("universal permissive license",)),
    Template("sspl", ("server side public license",)),
    Template("ecl", ("educational community license",)),
    Template("ncsa", ("university of illinois ncsa open source license",)),
    Template("w3c", ("w3c software notice and license",)),
    Template("qpl", ("q public license",)),
    Template("lppl", ("latex project public license",)),
    Template("zpl", ("zope public license",)),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows that hold each word of the templates. As many counts as the templates have words."""
    mine = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(*sorted(vocabulary))))
    found = docs.select(F.explode_outer(mine).alias("word"), F.monotonically_increasing_id().alias("row")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return docs.count(), {r.word: r.n for r in found if r.word is not None}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and places (label, phrase, start of every phrase that stands in the text).

    The score is the largest share, by weight of rarity, of a template's phrases that stand in the text.
    """
    docs = docs.select("doc_id", "text")
    phrases = sorted({p for t in templates for p in t.phrases})
    n, holding = document_frequencies(docs, {w for p in phrases for w in p.split()})
    rarity = {w: math.log((n + 1) / (holding.get(w, 0) + 1)) + 1e-3 for p in phrases for w in p.split()}
    number = {p: k for k, p in enumerate(phrases)}
    index = [_anchors(p, rarity) for p in phrases]
    by_word: dict[str, list[Column]] = {}
    for k, found in enumerate(index):
        for place, word in found:
            by_word.setdefault(word, []).append(F.struct(F.lit(k).alias("phrase"), F.lit(place).alias("place")))
    postings = F.create_map(*[c for word, found in sorted(by_word.items()) for c in (F.lit(word), F.array(*found))])
    needed = F.array(*[F.lit(len(found)) for found in index])
    spelled = F.array(*[F.array(*map(F.lit, p.split())) for p in phrases])

    rows = evaluated(docs, _words=words_of(F.col("text"))).drop("text")
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*sorted(by_word)))
    rows = evaluated(rows, _hits=hits, n_words=F.size("_words").cast("long"))

    def votes(hit: Column) -> Column:
        return F.transform(F.element_at(postings, hit["w"]), lambda p: F.struct(p["phrase"].alias("phrase"), (hit["i"] - p["place"]).alias("start")))

    rows = evaluated(rows, _votes=F.when(F.size("_hits") > 0, F.sort_array(F.flatten(F.transform("_hits", votes))))).drop("_hits")

    def stands(vote: Column, j: Column) -> Column:
        """A rare word votes once for a start at most, so votes that agree and are as many as the rare words come from all of them."""
        phrase = F.get(spelled, vote["phrase"])
        agreed = F.get("_votes", j - F.get(needed, vote["phrase"]) + 1).eqNullSafe(vote)
        return agreed & (vote["start"] >= 0) & (F.slice("_words", F.greatest(vote["start"], F.lit(0)) + 1, F.size(phrase)) == phrase)

    none = F.array().cast("array<struct<phrase:int,start:int>>")
    rows = evaluated(rows, _found=F.coalesce(F.filter("_votes", stands), none)).drop("_words", "_votes")
    rows = evaluated(rows, _there=F.array_distinct(F.transform("_found", lambda x: x["phrase"])))

    weights = [sum(rarity[w] for w in p.split()) for p in phrases]
    every = F.array(*[F.struct(F.lit(t.label).alias("label"), F.array(*[F.lit(number[p]) for p in t.phrases]).alias("phrases"), F.lit(sum(weights[number[p]] for p in t.phrases)).alias("weight")) for t in templates])
    weight = F.array(*map(F.lit, weights))

    def labels(some: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(some, lambda t: t["label"]))), ",")

    def share(t: Column) -> Column:
        return F.aggregate(F.array_intersect(t["phrases"], F.col("_there")), F.lit(0.0), lambda done, p: done + F.get(weight, p)) / t["weight"]

    holds = F.filter(every, lambda t: F.size(F.array_except(t["phrases"], F.col("_there"))) == 0)
    base = {number[p]: t.label for t in templates if t.base for p in t.phrases}
    base_found = F.filter("_found", lambda x: x["phrase"].isin(*base))
    base_starts = F.transform(base_found, lambda x: x["start"])
    base_label = F.create_map(*[c for k, label in sorted(base.items()) for c in (F.lit(k), F.lit(label))])
    some = F.size("_found") > 0

    def named(x: Column) -> Column:
        own = F.filter(every, lambda t: F.array_contains(t["phrases"], x["phrase"]))
        return F.transform(own, lambda t: F.struct(t["label"].alias("label"), F.array_join(F.get(spelled, x["phrase"]), " ").alias("phrase"), x["start"].alias("start")))

    return rows.select(
        "doc_id", "n_words", F.size(base_starts).cast("long").alias("n_base"),
        F.array_min(base_starts).cast("long").alias("first_word"), F.array_max(base_starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(base_found, lambda x: F.element_at(base_label, x["phrase"])))), ",").alias("base_labels"),
        F.when(some, labels(holds)).otherwise(F.lit("")).alias("labels"),
        F.when(some, F.least(F.lit(1.0), F.round(F.array_max(F.transform(every, share)), 9))).otherwise(F.lit(0.0)).alias("score"),
        F.flatten(F.transform("_found", named)).alias("places"),
    )


def _anchors(phrase: str, rarity: dict[str, float]) -> list[tuple[int, str]]:
    """Places and words of the rarest words of a phrase, each word at its first place."""
    words = phrase.split()
    first = {w: words.index(w) for w in words}
    return [(first[w], w) for w in sorted(first, key=lambda w: (-rarity[w], w))[:ANCHORS]]
