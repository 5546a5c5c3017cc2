"""License scans: an exact set-similarity join of text blocks with license templates.

A block (a paragraph) meets a template where it contains at least ``threshold``
of the template's distinct words.  Words are ordered by their frequency over
all documents, rarest first.  A block can only meet a template if it has a
word of the template's prefix (the first ``size - need + 1`` words); such a
word gives a candidate, which must pass the length filter and the positional
filter (what can still follow in both orders) before the sets are intersected.
The templates, a parameter of known size, are constants of the plan, indexed
by prefix word, so no row is shuffled but the counts of template words.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_columns_clashing

#: Phrases whose places count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening sentences of public licenses and notices, with their labels.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "This project is released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(_UPPER, _LOWER))
    return "".join(c if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c > "\x7f" else " " for c in lowered).split()


def normalised(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by single spaces, with a space before and after ("  " if none)."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def template_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """Template words, rarest first by the number of documents that have them."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    met = docs.select(F.explode(F.array_intersect(F.split(normalised(F.col(f"`{text_col}`")), " "), words)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    count = {r.w: r.n for r in met.collect()}  # at most one row for each template word
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _containment(text: Column, order: list[str], templates, threshold: float) -> Column:
    """For each block and template that meet: ``array<struct<label, share>>``."""
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(rank[w] for w in set(_words_of(t)))) for label, t in templates]
    prefixes: dict[int, list[tuple[int, int, int, int]]] = {}
    for number, (_, ranks) in enumerate(sets):
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            prefixes.setdefault(r, []).append((number, i, len(ranks), need))
    lit_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    vocabulary, ranks = lit_array(order), [lit_array(r) for _, r in sets]
    index = F.array(*[
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(need).alias("need")) for t, i, n, need in prefixes[r]]) if r in prefixes
        else F.array().cast("array<struct<t:int,i:int,n:int,need:int>>") for r in range(len(order))
    ])
    labels, table = lit_array([label for label, _ in sets]), F.array(*ranks)

    def of_block(block: Column) -> Column:
        found = F.array_intersect(F.split(normalised(block), " "), vocabulary)
        hits = F.array_sort(F.transform(found, lambda w: (F.array_position(vocabulary, w) - 1).cast("int")))
        return F.flatten(F.transform(F.array(hits), of_hits))

    def of_hits(hits: Column) -> Column:
        def candidates(r: Column) -> Column:
            place = F.array_position(hits, r).cast("int")
            left = F.size(hits) - place
            fits = lambda c: (F.size(hits) >= c["need"]) & (1 + F.least(c["n"] - c["i"] - 1, left) + F.least(c["i"], place - 1) >= c["need"])
            return F.transform(F.filter(F.element_at(index, r + 1), fits), lambda c: c["t"])

        some = F.array_distinct(F.flatten(F.transform(hits, candidates)))
        met = F.transform(some, lambda t: F.struct(F.element_at(labels, t + 1).alias("label"), (F.size(F.array_intersect(hits, F.element_at(table, t + 1))) / F.size(F.element_at(table, t + 1))).alias("share")))
        return F.filter(met, lambda m: m["share"] >= threshold - 1e-9)

    return F.flatten(F.transform(F.split(text, r"\n[ \t]*\n"), of_block))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Blocks end at empty lines (line feeds; a text with carriage returns before
    them is one block).  n_base counts the places of the phrases; first_word and last_word are the
    smallest and largest start (null without one).  labels adds those of the
    templates that a block meets.  score is the largest share met, 0.5 if only
    a phrase was found, else 0.  Null and empty texts have no words.  Repeated
    rows are scanned alike, and an empty table gives an empty one.  Columns with
    added names give way.
    """
    vocabulary = sorted({w for _, t in templates for w in _words_of(t)})
    order = template_order(docs, text_col, vocabulary)
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    given = drop_columns_clashing(docs.select(*keep) if keep else docs, *added)
    names = given.columns
    text = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.coalesce(text, F.lit("")).alias("text"), normalised(text).alias("words"))
    words = F.col("words")
    any_phrase = "|".join(PHRASES)
    prefix = F.array(*[F.lit(w) for w in _prefix_words(order, templates, threshold)])
    rows = (
        rows.withColumn("some", F.contains(words, F.lit(" license ")))
        .withColumn("near", F.arrays_overlap(F.split(words, " "), prefix))
        .withColumn("met", F.when(F.col("near"), _containment(F.col("text"), order, templates, threshold)).otherwise(F.array().cast("array<struct<label:string,share:double>>")))
    )
    places = {p: F.when(F.col("some"), F.regexp_count(words, F.lit(f" {p}(?= )"))).otherwise(F.lit(0)) for p in PHRASES}
    first = F.regexp_extract(words, rf"^(?s:(.*?)) (?:{any_phrase}) ", 1)
    last = F.regexp_extract(words, rf"^(?s:(.*)) (?:{any_phrase}) ", 1)
    base = F.filter(F.array(*[F.when(n > 0, F.lit(PHRASES[p])) for p, n in places.items()]), lambda x: x.isNotNull())
    n_base = sum(places.values(), F.lit(0))
    rows = rows.withColumn("base", base).withColumn("n_base", n_base.cast("long"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("met", lambda m: m["share"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(names)],
        F.when(words == "  ", F.lit(0)).otherwise(_spaces(words) - 1).cast("long").alias("n_words"),
        "n_base",
        F.when(F.col("n_base") > 0, _spaces(first)).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, _spaces(last)).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("met", lambda m: m["label"])))), ",").alias("labels"),
        score.alias("score"),
    )


def _prefix_words(order: list[str], templates, threshold: float) -> list[str]:
    rank = {w: i for i, w in enumerate(order)}
    out = set()
    for _, t in templates:
        words = sorted(set(_words_of(t)), key=rank.get)
        out.update(words[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1])
    return sorted(out)


def oracle_sql(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the same rows: each block against each template."""
    rows = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in sorted(set(_words_of(t))))}])" for i, (label, t) in enumerate(templates))
    norm = "' ' || trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') || ' '"
    return rf"""
WITH t(number, label, words) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {norm.format("coalesce(text, '')")} AS w, row_number() OVER () AS row FROM documents),
b AS (SELECT row, {norm.format("block")} AS w FROM (SELECT row, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS block FROM d)),
s AS (SELECT row, list_distinct(string_split(w, ' ')) AS words FROM b),
m AS (SELECT s.row, t.label, len(list_intersect(s.words, t.words)) / CAST(len(t.words) AS DOUBLE) AS share FROM s, t
      WHERE len(list_intersect(s.words, t.words)) >= {threshold} * len(t.words) - 1e-9),
g AS (SELECT row, list(label) AS labels, max(share) AS share FROM m GROUP BY row),
c AS (SELECT d.*, (len(w) - len(replace(w, ' mit license', ''))) // 12 AS x,
      CAST(len(regexp_extract_all(replace(w, ' ', '  '), ' mit  license ')) AS BIGINT) AS n_mit,
      CAST(len(regexp_extract_all(replace(w, ' ', '  '), ' apache  license ')) AS BIGINT) AS n_apache,
      CAST(len(regexp_extract_all(replace(w, ' ', '  '), ' general  public  license ')) AS BIGINT) AS n_gpl,
      regexp_extract(w, '(?s)^(.*?) (?:mit license|apache license|general public license) ', 1) AS f,
      regexp_extract(w, '(?s)^(.*) (?:mit license|apache license|general public license) ', 1) AS l FROM d),
e AS (SELECT c.*, n_mit + n_apache + n_gpl AS n_base,
      list_filter([CASE WHEN n_mit > 0 THEN 'mit' END, CASE WHEN n_apache > 0 THEN 'apache' END, CASE WHEN n_gpl > 0 THEN 'gpl' END], lambda x: x IS NOT NULL) AS base,
      coalesce(g.labels, []) AS more, coalesce(g.share, 0) AS share FROM c LEFT JOIN g ON c.row = g.row)
SELECT doc_id, CAST(CASE WHEN w = '  ' THEN 0 ELSE len(w) - len(replace(w, ' ', '')) - 1 END AS BIGINT) AS n_words, n_base,
       CAST(CASE WHEN n_base > 0 THEN len(f) - len(replace(f, ' ', '')) END AS BIGINT) AS first_word,
       CAST(CASE WHEN n_base > 0 THEN len(l) - len(replace(l, ' ', '')) END AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
       greatest(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS score
FROM e
"""
