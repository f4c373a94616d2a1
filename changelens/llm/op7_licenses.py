"""License scan: phrases, and an exact set-similarity join of text blocks with license templates, in DataFrame functions.

A block is a window of up to LINES neighbouring lines of a paragraph (for statements of a line, which may be wrapped) or a
paragraph between blank lines (for longer notices); a window holds all shorter ones, so these need no look of their own. Template
T is found in block B if B holds at least o = ceil(THRESHOLD * |T|) of T's distinct words. Only words of some template
can count, so blocks are reduced to these while the text is read. Words are ordered by their number of lines over all
documents, rarest first; then a block that reaches o for T shares a word of T's prefix (the first |T| - o + 1)
with its own prefix, so prefixes are joined by word, and candidates pass the length filter
(|B| >= o) and the positional filter (words left after the match) before the words are intersected. The
filters lose no block that meets the threshold. Templates are a constant table, which bounds what is broadcast.

Defined results: null and empty texts have no words, labels '' and score 0; repeated rows and null ids give
a row each; an empty table gives no rows; extra columns are not read. Places of a phrase may overlap.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.rows import let
from changelens.llm.common import stored

THRESHOLD = 0.8
LINES = 3
#: The phrases that are always looked for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known license statements of one line (kind line) and notices (kind paragraph).
TEMPLATES = [
    ("line", "apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("line", "mit", "Released under the MIT License"),
    ("line", "mit", "SPDX-License-Identifier: MIT"),
    ("line", "apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("line", "gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("line", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("line", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("line", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("line", "gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("line", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("line", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("line", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("paragraph", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("paragraph", "lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("paragraph", "agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("paragraph", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("paragraph", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("paragraph", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("paragraph", "apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_LINE = r"\n[ \t\r]*\n"


def words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def _need(n: int, threshold: float) -> int:
    return math.ceil(round(threshold * n, 9))


def reduced(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The stored rows: row_no, doc_id, n_words, starts by phrase, and blocks reduced to the templates' words."""
    names = F.array(*[F.lit(w) for w in sorted({w for _, _, t in templates for w in words(t)})])
    text = F.lower(F.coalesce("text", F.lit("")))
    lines = F.transform(F.split(text, _BLANK_LINE), lambda p: F.transform(F.split(p, "\n"), lambda x: F.array_remove(F.split(x, GAP), "")))
    hit = [text.contains(p.split(" ")[0]) & text.contains(p.split(" ")[-1]) for p in PHRASES]
    rows = docs.select("doc_id", lines.alias("paragraphs"), *[h.alias(f"p{i}") for i, h in enumerate(hit)])

    def starts(all_words: Column, phrase: str) -> Column:
        parts = phrase.split(" ")
        fits = lambda i: math_and([F.get(all_words, i + k) == p for k, p in enumerate(parts)])
        return F.when(F.size(all_words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(all_words) - len(parts)), fits)).otherwise(F.expr("CAST(array() AS array<int>)"))

    def math_and(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    none = F.expr("CAST(array() AS array<int>)")
    whole = F.flatten(F.flatten("paragraphs"))
    found = F.transform(F.array(F.when(F.col("p0") | F.col("p1") | F.col("p2"), whole)), lambda w: F.array(*[F.when(F.col(f"p{i}"), starts(w, p)).otherwise(none) for i, p in enumerate(PHRASES)]))[0]
    few = {kind: min([_need(len(set(words(t))), threshold) for k, _, t in templates if k == kind], default=1 << 30) for kind in ("line", "paragraph")}

    def blocks(held: Column) -> Column:
        window = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - LINES, F.lit(0))), lambda i: F.array_distinct(F.flatten(F.slice(p, i + 1, LINES))))
        notices = F.transform(held, lambda p: F.array_distinct(F.flatten(p)))
        return F.struct(F.filter(F.flatten(F.transform(held, window)), lambda b: F.size(b) >= few["line"]).alias("lines"),
                        F.filter(notices, lambda b: F.size(b) >= few["paragraph"]).alias("notices"))

    kept = F.transform("paragraphs", lambda p: F.transform(p, lambda w: F.array_intersect(w, names)))
    full = F.filter(kept, lambda p: F.exists(p, lambda w: F.size(w) > 0))
    n_words = F.aggregate(F.transform(F.flatten("paragraphs"), lambda w: F.size(w).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.select("doc_id", n_words.alias("n_words"), found.alias("starts"), let(full, blocks).alias("b")).select("doc_id", "n_words", "starts", "b.*")
    return stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "blocks")


def template_matches(rows: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row_no, kind, block, label, containment) of every block that reaches the threshold for a template."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.select(F.explode("lines").alias("b")).select(F.explode("b").alias("w")).groupBy("w").count().collect()}  # the templates' words at most
    order = {w: i for i, w in enumerate(sorted({w for _, _, t in templates for w in words(t)}, key=lambda w: (counts.get(w, 0), w)))}
    kinds = {k: [] for k, _, _ in templates}
    table = []
    for i, (kind, label, text) in enumerate(templates):
        own = sorted(set(words(text)), key=order.get)
        need = _need(len(own), threshold)
        kinds[kind].append(need)
        table += [(i, kind, label, own, need, w, at) for at, w in enumerate(own[: len(own) - need + 1])]
    prefixes = spark.createDataFrame(table, "template int, kind string, label string, own array<string>, need int, word string, i int")
    ranks = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    blocks = rows.select("row_no", F.lit("line").alias("kind"), F.posexplode("lines").alias("block", "b")).union(rows.select("row_no", F.lit("paragraph"), F.posexplode("notices").alias("block", "b")))
    least = F.when(F.col("kind") == "line", min(kinds.get("line", [1 << 30]), default=1 << 30)).otherwise(min(kinds.get("paragraph", [1 << 30]), default=1 << 30))
    blocks = blocks.filter(F.size("b") >= least)
    ordered = F.transform(F.array_sort(F.transform("b", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    blocks = blocks.select("row_no", "kind", "block", ordered.alias("b"), least.alias("least"))
    ends = F.slice("b", 1, F.size("b") - F.col("least") + 1)
    pairs = blocks.select("row_no", "kind", "block", "b", F.posexplode(ends).alias("j", "word")).join(F.broadcast(prefixes), ["kind", "word"])
    left = F.lit(1) + F.least(F.size("own") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    pairs = pairs.filter((F.size("b") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("b", "own"))
    return pairs.withColumn("overlap", overlap).filter("overlap >= need").select("row_no", "kind", "block", "template", "label", (F.col("overlap") / F.size("own")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    The score is 1 with a phrase, else the best containment found, else 0.
    """
    rows = reduced(docs, templates, threshold)
    found = template_matches(rows, templates, threshold).groupBy("row_no").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    all_starts = F.flatten("starts")
    base = F.filter(F.array(*[F.when(F.size(F.col("starts")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    rows = rows.select("row_no", "doc_id", "n_words", F.coalesce(F.size(all_starts), F.lit(0)).alias("n"), F.array_min(all_starts).cast("long").alias("first_word"), F.array_max(all_starts).cast("long").alias("last_word"), base.alias("base"))
    rows = rows.join(found, "row_no", "left")
    return rows.select("doc_id", "n_words", F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                       F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.expr("CAST(array() AS array<string>)")))), ",").alias("labels"),
                       F.when(F.col("n") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
