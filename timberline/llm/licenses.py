"""License notices in texts, by an exact set-similarity join with DataFrame functions alone.

A template is the set of words of a notice; a text block is a run of neighbouring lines; a block meets a template that it
contains to a threshold: 100 * |common words| >= threshold * |template|. Words are ordered by the number of documents
that hold them, rarest first. Of a template's words at most |template| - needed may be absent, so a block that meets it has
one of its first |template| - needed + 1, its prefix: blocks and templates join on these rare words alone. The
first word they share, at place i of the one and j of the other, leaves room for min(|template| - i, |block| - j) common words (the
positional filter), and a block needs as many words as must be common (the length filter). Pairs that pass are counted exactly.

Templates are a parameter of fixed size, whatever the corpus: their words, counts and prefixes are what is
collected and broadcast. Of blocks only the words of templates are kept, since others cannot be common.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 90  # per cent of a template's words
BLOCK_LINES = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, and notices that licenses ask to be given.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Licensed under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "licensed under a Creative Commons License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("proprietary", "Copyright. All rights reserved"),
)


def template_words(text: str) -> list[str]:
    """The distinct words of a template, in order."""
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))))


def needed(size: int, threshold: int) -> int:
    """Least number of common words."""
    return -(-threshold * size // 100)


def _spaced(text: Column) -> Column:
    """The words of a text, A-Z folded, with one space between and around them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, _UPPER, _LOWER), F.lit(" ")), _BETWEEN, " ")


def _words(spaced: Column) -> Column:
    return F.when(F.length(spaced) < 2, F.array().cast("array<string>")).otherwise(F.split(F.trim(spaced), " "))


def _any_of(spaced: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in a spaced text."""
    return spaced.rlike(" (?:" + "|".join(map(re.escape, sorted(words))) + ") ")


def _literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def word_order(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> list[str]:
    """``words`` by the number of documents that hold them, rarest first, then by the word."""
    spaced = _spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = docs.select(F.explode(F.array_intersect(_literal(words), _words(spaced))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def license_blocks(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: int = THRESHOLD,
    block_lines: int = BLOCK_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``id``, ``text_hash``, ``block``, ``template``, ``label``, ``containment``) of every block that meets a template.

    A block is ``block_lines`` lines from line ``block`` (from 0), or the whole of a text with fewer lines. ``template`` is its place
    in ``templates``. A null text has no blocks; equal rows give equal rows.
    """
    spark = docs.sparkSession
    sets = [template_words(text) for _, text in templates]
    rank = {w: i for i, w in enumerate(word_order(docs, sorted({w for s in sets for w in s}), text_col))}
    order = sorted(rank, key=rank.get)
    ordered = [sorted(s, key=rank.get) for s in sets]
    prefixes = [
        (i, label, words[place], place, len(words), needed(len(words), threshold), words)
        for i, ((label, _), words) in enumerate(zip(templates, ordered))
        for place in range(len(words) - needed(len(words), threshold) + 1 if words else 0)
    ]
    rare = spark.createDataFrame(prefixes, "template int, label string, word string, at int, size int, needed int, words array<string>")
    keys = sorted({p[2] for p in prefixes})
    if not keys:
        none = "CAST(NULL AS {})"
        kinds = {"text_hash": "bigint", "block": "int", "template": "int", "label": "string", "containment": "double"}
        return docs.limit(0).select(F.col(id_col).alias("id"), *[F.expr(none.format(k)).alias(c) for c, k in kinds.items()])

    text = F.col(text_col).cast("string")
    lines = F.transform(F.split(text, "\n"), _spaced)
    # Only the lines' words are repeated in blocks, and only texts with a rare word have any.
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - block_lines, F.lit(0)))
    blocks = F.transform(starts, lambda i: F.struct(i.alias("block"), F.concat_ws(" ", F.slice(F.col("lines"), i + 1, block_lines)).alias("spaced")))
    held = (
        docs.where(text.isNotNull() & _any_of(_spaced(text), keys))
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), lines.alias("lines"))
        .select("id", "text_hash", F.explode(F.filter(blocks, lambda b: _any_of(b["spaced"], keys))).alias("_b"))
        .select("id", "text_hash", "_b.block", F.array_intersect(_literal(order), F.split(F.trim("_b.spaced"), " +")).alias("held"))
    )
    first = held.select("*", F.posexplode("held").alias("place", "word")).join(F.broadcast(rare), "word")
    room = F.least(F.col("size") - F.col("at"), F.size("held") - F.col("place"))
    common = F.size(F.array_intersect("words", "held"))
    pairs = first.where((F.size("held") >= F.col("needed")) & (room >= F.col("needed"))).withColumn("common", common)
    met = pairs.where(F.col("common") >= F.col("needed"))
    columns = ["id", "text_hash", "block", "template", "label"]
    # A pair that shares several words of the prefix came up for each of them.
    return met.groupBy(*columns).agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def _phrase_places(words: Column, phrases: Mapping[str, str]) -> Column:
    """(start, label) of every place of a phrase, by start."""

    def at(word: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<start:bigint,label:string>")
        for phrase, label in phrases.items():
            *before, last = phrase.split(" ")
            stands = word == last
            for back, other in enumerate(reversed(before), 1):
                stands = stands & (F.get(words, i - back) == other)
            place = F.struct((i - len(before)).cast("bigint").alias("start"), F.lit(label).alias("label"))
            found = F.when(stands, place).otherwise(found)
        return found

    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: int = THRESHOLD,
    block_lines: int = BLOCK_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    The base is the places where a phrase's words stand one after the other: their number, their least and greatest start (words
    from 0, null if there is none), their labels. ``labels`` also has those of the templates that a block of the text meets. ``score`` is the greatest
    containment of a template that is met, 1 where a phrase stands, else 0. A null text counts as empty; equal rows give equal rows.
    No two phrases may end at the same word.
    """
    spaced = _spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), text_hash.alias("_hash"), spaced.alias("_spaced"))
    lasts = {p.rpartition(" ")[2] for p in phrases}
    words = _words(F.col("_spaced"))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    rows = rows.select(
        "_id",
        "_hash",
        F.size(words).cast("bigint").alias("n_words"),
        F.when(_any_of(F.col("_spaced"), lasts), _phrase_places(words, phrases)).otherwise(none).alias("places"),
    )
    blocks = license_blocks(docs, templates, threshold, block_lines, id_col, text_col)
    met = blocks.groupBy("id", "text_hash").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))
    found = rows.join(met, same, "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["start"])
    every = F.array_union(base, F.coalesce("met", F.array().cast("array<string>")))
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
