"""License scans by a positional rare-token index, in DataFrame functions only.

Method. How many documents hold each word of the templates is counted over all
rows. Each template is filed under its words of high IDF (in at most RARE_SHARE of
the documents, and at least the rarer half of its words), with their positions. A
document looks up the words it shares with the index; every occurrence votes for (template, document position - template position). Where two
postings agree on that relative position, the template's key phrase must stand at
exactly its place; then the template counts, scored by the share of its words that
stand where they should. Base phrases are found wherever their words are
consecutive, and their labels always stay.

All this happens within a row: no shuffle, and nothing but constant maps (the
templates are fixed values). The positional part runs only for documents that
hold an index word.

Edge cases: null and empty texts have no words and no labels (empty strings,
score 0, first_word and last_word null); overlapping phrases count each start;
words that run on past ASCII are other words; repeated rows are scanned alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import ascii_lower

#: What separates words, after lower-casing.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RARE_SHARE = 0.05
#: Relative positions are shifted so that they stay positive; no template is longer.
SHIFT = 1_000


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str


#: Phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licence notices (words as the scan sees them), and the phrase that each must hold.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "licensed under the bsd license", "bsd license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights cc0", "waived all copyright and related or neighboring rights"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _spaced(text: Column) -> Column:
    """Words joined by single spaces, A-Z lower-cased."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def _list(values: list[str]) -> Column:
    """A constant array of words."""
    return F.split(F.lit(" ".join(values)), " ")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str | None, int]:
    """Documents that hold each template word, over all rows; None holds how many documents there are."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    own = F.array_intersect(F.split(_spaced(F.col(text_col)), " "), _list(vocabulary))
    shared = docs.select(F.concat(own, F.array(F.lit(""))).alias("w"))
    found = shared.select(F.explode_outer("w").alias("w")).groupBy("w").count().collect()
    return dict.fromkeys([None, *vocabulary], 0) | {w or None: n for w, n in found}


def build_index(frequencies: dict[str | None, int], templates: tuple[Template, ...] = TEMPLATES, rare_share: float = RARE_SHARE) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) postings of each template's words of high IDF."""
    total = frequencies.get(None, 0)
    idf = lambda w: math.log((1 + total) / (1 + frequencies.get(w, 0)))
    rare = math.log((1 + total) / (1 + rare_share * total))
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words.split()
        distinct = sorted(set(words), key=lambda w: (-idf(w), w))
        for k, w in enumerate(distinct):
            if 2 * k < len(distinct) or idf(w) >= rare:
                index.setdefault(w, []).extend((t, p) for p, x in enumerate(words) if x == w)
    return index


def scan(docs: DataFrame, index: dict[str, list[tuple[int, int]]], templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    names = sorted(index)
    none = F.array().cast("array<bigint>")
    df = docs.select(F.col(id_col).alias("_id"), _spaced(F.col(text_col)).alias("_text"))
    df = df.withColumns(
        {
            "n_words": F.when(F.col("_text") == "", F.lit(0)).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit(""))) + 1).cast("bigint"),
            "_padded": F.concat(F.lit(" "), "_text", F.lit(" ")),
            "_words": F.split("_text", " "),
        }
    )
    holds = [F.contains(F.col("_padded"), F.lit(f" {phrase} ")) for phrase, _ in BASE]
    df = df.withColumns({f"_b{k}": h for k, h in enumerate(holds)} | {"_rare": F.array_intersect("_words", _list(names))})
    base = [F.col(f"_b{k}") for k in range(len(BASE))]

    def starts_here(i: Column) -> Column:
        out = F.lit(False)
        for phrase, _ in BASE:
            here = F.lit(True)
            for k, w in enumerate(phrase.split()):
                here = here & F.coalesce(F.get("_words", i + k) == w, F.lit(False))
            out = out | here
        return out

    places = F.sequence(F.lit(0), F.size("_words") - 1)
    any_base = base[0] | base[1] | base[2]
    # a posting is template * 10000 + position; a vote is template * 2**40 + relative position + SHIFT
    postings = F.split(F.lit(";".join(" ".join(str(t * 10_000 + p) for t, p in index[w]) for w in names)), ";")
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(F.array_position(F.col("_rare"), w).alias("r"), w.alias("w"), i.alias("i"))), lambda x: x["r"] > 0)
    df = df.withColumns({"_starts": F.when(any_base, F.filter(places, starts_here)), "_hits": F.when(F.size("_rare") > 0, hits)})
    votes = F.flatten(
        F.transform(
            "_hits",
            lambda x: F.transform(
                F.split(F.get(postings, (F.array_position(_list(names), x["w"]) - 1).cast("int")), " ").cast("array<bigint>"),
                lambda e: F.floor(e / 10_000).cast("bigint") * F.lit(1 << 40) + x["i"] - F.pmod(e, F.lit(10_000)) + F.lit(SHIFT),
            ),
        )
    )
    df = df.withColumn("_votes", F.when(F.size("_hits") > 1, F.sort_array(votes))).drop("_hits")
    agreed = F.filter(
        F.sequence(F.lit(0), F.size("_votes") - 1),
        lambda j: F.coalesce(F.get("_votes", j) == F.get("_votes", j + 1), F.lit(False)) & F.coalesce(F.get("_votes", j) != F.get("_votes", j - 1), F.lit(True)),
    )
    df = df.withColumn("_agreed", F.when(F.size("_votes") > 1, F.transform(agreed, lambda j: F.get("_votes", j))).otherwise(none)).drop("_votes")
    parts = [t.words.split() for t in templates]
    keys = [t.key.split() for t in templates]
    fixed = lambda values: F.split(F.lit(";".join(map(str, values))), ";")
    texts, phrases, labels = fixed([t.words for t in templates]), fixed([t.key for t in templates]), fixed([t.label for t in templates])
    key_at, key_n = fixed([_at(p, k) for p, k in zip(parts, keys)]).cast("array<int>"), fixed([len(k) for k in keys]).cast("array<int>")

    def verified(v: Column) -> Column:
        t = F.floor(v / F.lit(1 << 40)).cast("int")
        at = (F.pmod(v, F.lit(1 << 40)) - SHIFT).cast("int")
        here = F.array_join(F.slice("_words", F.greatest(at + F.get(key_at, t), F.lit(0)) + 1, F.get(key_n, t)), " ")
        template = F.split(F.get(texts, t), " ")
        right = F.size(F.filter(F.transform(template, lambda w, p: F.coalesce(F.get("_words", at + p) == w, F.lit(False))), lambda ok: ok))
        found = (at + F.get(key_at, t) >= 0) & (here == F.get(phrases, t))
        return F.struct(found.alias("ok"), F.get(labels, t).alias("label"), (right / F.size(template)).alias("share"))

    df = df.withColumn("_found", F.when(F.size("_agreed") > 0, F.filter(F.transform("_agreed", verified), lambda x: x["ok"])))
    base_labels = F.filter(F.array(*[F.when(b, F.lit(label)) for b, (_, label) in zip(base, BASE)]), lambda x: x.isNotNull())
    own = F.coalesce(F.transform("_found", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return df.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(F.size("_starts")).cast("bigint").alias("n_base"),
        F.get("_starts", F.lit(0)).cast("bigint").alias("first_word"),
        F.get("_starts", F.size("_starts") - 1).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own)).alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(best).alias("score"),
    )
