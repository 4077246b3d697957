"""Licence scans over a positional rare-token index.

A template is a run of up to 63 words, a licence's name or the notice that files carry, with
mandatory key phrases; what else of it stands at its place makes its score. The index
holds, per licence word, its postings (template, position in the template). Of a
file only the licence words and their positions are read off. Each template is
looked up by the word of its key phrases that is rarest in the corpus (highest IDF).
Only where that word stands is there a candidate, file position minus template
position being its alignment; the licence words around it are intersected with the
template by relative position, and the alignment counts when the key phrases stand in
full. They hold the looked-up word, so results don't depend on which one it is.

Native column functions only. Words are runs of digits, letters and non-ASCII
characters, compared in lower case (A-Z). A null text has no words; repeated rows
and null ids each get their own result row; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import TERM_GAP, whole_text, written


@dataclass(frozen=True)
class Template:
    """``key_phrases`` are parts of ``text`` that must stand word for word."""

    label: str
    text: str
    key_phrases: tuple[str, ...]
    base: bool = False

    def __post_init__(self):
        if len(self.words) > 63:
            raise ValueError("a template's places are the bits of a long: 63 words at most")

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split())

    @property
    def must(self) -> int:
        """The positions of all key phrases, as bits."""
        bits = 0
        for phrase in self.key_phrases:
            words = tuple(phrase.split())
            at = next(i for i in range(len(self.words)) if self.words[i:i + len(words)] == words)
            bits |= ((1 << len(words)) - 1) << at
        return bits

    @property
    def lookup(self) -> tuple[str, ...]:
        """The words it may be looked up by: those of its key phrases, without common ones if others are left."""
        words = tuple(w for i, w in enumerate(self.words) if self.must >> i & 1)
        return tuple(w for w in words if w not in COMMON) or words


def phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base)


BASE: tuple[Template, ...] = (
    phrase("cc-by", "cc by", True),
    phrase("gpl", "general public license", True),
    phrase("reserved", "all rights reserved", True),
)
MORE: tuple[Template, ...] = (
    Template("mit", "released under the mit license", ("mit license",)),
    phrase("mit", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    phrase("lgpl", "lesser general public license"),
    phrase("agpl", "affero general public license"),
    phrase("mpl", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    phrase("bsd", "redistribution and use in source and binary forms"),
    phrase("isc", "permission to use copy modify and or distribute this software"),
    phrase("public-domain", "released into the public domain"),
)
# The notices that the licences ask files to carry, as words.
NOTICES: tuple[Template, ...] = (
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
             "compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
             ("apache license version 2 0", "in compliance with the license")),
    Template("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of "
             "the gnu general public license as published by the free software foundation either version 3 of the license "
             "or at your option any later version",
             ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of "
             "the gnu general public license as published by the free software foundation either version 2 of the license "
             "or at your option any later version",
             ("gnu general public license", "either version 2 of the license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including without "
             "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met redistributions of source code must retain the above copyright notice "
             "this list of conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
             "mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
             ("mozilla public license v 2 0", "you can obtain one at")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
             ("distribute this software for any purpose", "this permission notice appear in all copies")),
    Template("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license "
             "to view a copy of this license visit http creativecommons org licenses by sa 4 0",
             ("creative commons attribution sharealike", "to view a copy of this license")),
)
TEMPLATES = BASE + MORE + NOTICES
# Words too common in prose to look anything up by.
COMMON = frozenset("0 2 3 4 a all and any at by can copy file for forms free if in into is may not of one or public "
                   "released source that the this to under use v version was with without you your".split())


def index_words(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def lookup_words(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.lookup})


def licence_terms(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per document: key, row_no, n_words, terms (its licence words with positions;
    none where no template can be looked up by any of them). Written to the shared folder, so that
    row_no, which tells repeated rows apart, stays as it is."""
    vocabulary = index_words(templates)
    lookup = lookup_words(templates)
    t = F.col("text")
    body = F.regexp_replace(t, f"^{TERM_GAP}+|{TERM_GAP}+$", "")
    rows = docs.select(F.col(f"`{key}`").alias(key), whole_text(F.col(f"`{text}`")).alias("text"))
    rows = rows.withColumn("body", body).withColumn(
        "words", F.when(F.length("body") > 0, F.split("body", TERM_GAP + "+"))
        .otherwise(F.array().cast("array<string>")))
    # lower() also folds a few non-ASCII letters onto ASCII ones: such a word is longer in bytes
    tagged = F.transform("words", lambda w, i: F.when(
        F.lower(w).isin(*vocabulary) & (F.octet_length(w) == F.octet_length(F.lower(w))),
        F.struct(F.lower(w).alias("word"), i.alias("pos"))))
    rows = rows.withColumn("terms", F.filter(tagged, lambda x: x.isNotNull()))
    rows = rows.select(key, F.monotonically_increasing_id().alias("row_no"), F.size("words").cast("long").alias("n_words"),
                       F.when(F.exists("terms", lambda x: x["word"].isin(*lookup)), F.col("terms"))
                       .otherwise(F.array().cast("array<struct<word:string,pos:int>>")).alias("terms"))
    return written(rows, "licence-terms")


def idf(terms: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, float]:
    """log((1 + n) / (1 + df)) of every lookup word over all documents. At most one
    row per word of the templates reaches the driver."""
    n, lookup = terms.count(), lookup_words(templates)
    counted = (terms.select(F.explode(F.array_distinct(F.col("terms.word"))).alias("word"))
               .where(F.col("word").isin(*lookup)).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    df = {r["word"]: r["df"] for r in counted.collect()}
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in lookup}


def alignments(terms: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """row_no, template (its number), start (word position in the file), score of every
    alignment at which all key phrases stand. Candidates come from the looked-up words
    alone; each reads the few terms around it, so no other term becomes a row."""
    weight = idf(terms, templates)
    heavy = [max(t.lookup, key=lambda w: (weight[w], w)) for t in templates]
    # the key phrases stand in full: of a word's places in them, one is enough to look up by
    place = [next(i for i, w in enumerate(t.words) if w == heavy[k] and t.must >> i & 1)
             for k, t in enumerate(templates)]
    longest = max(len(t.words) for t in templates)
    bit = F.array(*[F.lit(1 << i).cast("long") for i in range(longest)])

    def postings(word: str) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("template"), F.lit(place[k]).alias("offset"),
                                  F.lit(t.must).cast("long").alias("must"),
                                  F.array(*[F.lit(w) for w in t.words]).alias("words"))
                         for k, t in enumerate(templates) if heavy[k] == word])

    index = F.create_map(*[x for w in sorted(set(heavy)) for x in (F.lit(w), postings(w))])

    def aligned(term: Column, at: Column, p: Column) -> Column:
        """The template placed at a term: the bits of its words that stand there. Terms have
        growing positions, so they are all among the ``longest`` terms to either side."""
        start = term["pos"] - p["offset"]
        first = F.greatest(at - longest, F.lit(0))
        near = F.slice("terms", first + 1, F.lit(2 * longest + 1))
        bits = F.aggregate(near, F.lit(0).cast("long"), lambda b, x: F.when(
            F.get(p["words"], x["pos"] - start) == x["word"],
            b.bitwiseOR(F.get(bit, x["pos"] - start))).otherwise(b))
        return F.struct(p["template"].alias("template"), start.alias("start"), p["must"].alias("must"), bits.alias("bits"))

    standing = F.transform("terms", lambda t, i: F.when(t["word"].isin(*sorted(set(heavy))), F.filter(
        F.transform(F.element_at(index, t["word"]), lambda p: aligned(t, i, p)),
        lambda m: m["bits"].bitwiseAND(m["must"]) == m["must"])))
    met = terms.select("row_no", F.explode(F.flatten(F.filter(standing, lambda x: F.size(x) > 0))).alias("m"))
    size = F.get(F.array(*[F.lit(len(t.words)) for t in templates]), F.col("m.template"))
    return met.select("row_no", "m.template", "m.start", (F.bit_count("m.bits") / size).cast("double").alias("score"))


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: key, n_words, ``spans`` (label, base, start, end in words, score)
    of all templates found, and ``score``, the best of them (0 without any)."""
    terms = licence_terms(docs, key, text, templates)
    label = F.get(F.array(*[F.lit(t.label) for t in templates]), F.col("template"))
    base = F.get(F.array(*[F.lit(t.base) for t in templates]), F.col("template"))
    size = F.get(F.array(*[F.lit(len(t.words)) for t in templates]), F.col("template"))
    found = alignments(terms, templates).groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("start").cast("long").alias("start"), (F.col("start") + size).cast("long").alias("end"),
            label.alias("label"), base.alias("base"), "score"))).alias("spans"),
        F.max("score").alias("score"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,label:string,base:boolean,score:double>>")
    return terms.select(key, "row_no", "n_words").join(found, "row_no", "left").select(
        key, "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score"))
