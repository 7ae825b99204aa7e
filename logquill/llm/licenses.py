"""Licence scans, in DataFrame functions only: an exact set-similarity join of text blocks with
licence templates.

A block is a window of WIDTH times as many words as a template has, wherever it starts, across line
ends too; as a set of lower-cased words it matches if it holds at least `threshold` of the template's
words, and its telling ones among them. Texts are read once: what is kept of them is where words of
any template stand, and everything else is told from those places. Template words are ordered by the
number of documents they occur in, over all documents, rarest first. A text with a matching block
must hold one of the first |T| - needed + 1 words of that order (prefix filter), and in all as many of the template's
words as are needed (length filter). Windows that start at one of the template's words hold what any other does; one is only looked at if
the needed-th of those words from its start on still stands in it (positional filter: what is left from a place bounds
what a window can share). What passes is verified, so the join misses nothing. One text per digest is
joined.

Templates are a parameter of a few dozen notices, so their tables have a fixed size, which is what
makes broadcasting them safe.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import stored

#: A word, capitals among its letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed phrases of the base and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Licence notices by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "all rights reserved"),
    ("mit", """the above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement"""),
    ("bsd", """redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies"""),
    ("apache-2.0", """you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version of the license or at your option any later version"""),
)
#: Words without which a notice is another licence or version, by label.
TELLING = {"apache-2.0": "apache 2", "cc-by-nc": "nc", "cc-by-sa": "sa", "gpl-3.0": "3", "mpl-2.0": "mozilla 2"}
THRESHOLD = 0.8
#: Words of a block for each word of the template.
WIDTH = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def template_rows(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, str, int, int, bool]]:
    """(template, label, word, number of distinct words of its notice, number needed, telling) for each
    distinct word."""
    out = []
    for i, (label, notice) in enumerate(templates):
        ws = sorted(set(re.findall("[0-9a-z]+", notice)))
        need, telling = math.ceil(threshold * len(ws) - 1e-9), TELLING.get(label, "").split()
        out += [(i, label, w, len(ws), need, w in telling) for w in ws]
    return out


def with_places(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, digest of the text, n_words and held (array<struct<at, word>>): where words of the
    templates or of the base phrases stand, told by one look at each text."""
    text = F.coalesce("text", F.lit(""))
    known = sorted({w for _, notice in templates for w in re.findall("[0-9a-z]+", notice)} | {w for p, _ in PHRASES for w in p.split(" ")})
    # words of other letters that become one of those in lower case are told apart by lowered()
    hit = lambda w, i: F.when(F.lower(w).isin(known), F.struct(i.cast("long").alias("at"), lowered(w).alias("word")))
    found = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    held = F.filter(F.transform("words", hit), lambda x: x["word"].isin(known))
    return found.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), held.alias("held"))


def phrase_places(held: Column, phrase: str) -> Column:
    """Starts, in words, of the places where the words of phrase stand consecutively (they may
    overlap), from the places of known words."""
    parts = phrase.split(" ")

    def here(x: Column, j: Column) -> Column:
        same = x["word"] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            later = F.get(held, j + k)
            same = same & F.coalesce((later["word"] == part) & (later["at"] == x["at"] + k), F.lit(False))
        return F.when(same, x["at"])

    return F.array_compact(F.transform(held, here))


def word_frequencies(texts: DataFrame) -> dict[str, int]:
    """Number of texts that hold each word of the templates, over all of texts (held); one row per
    word of the vocabulary reaches the driver."""
    hits = texts.select(F.explode(F.array_distinct("held.word")).alias("word"))
    return {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}


def ordered_templates(texts: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of template_rows with the number of words of its template, the rank of each word (order
    over all templates, rarest first) and its position in its template."""
    rows = template_rows(templates, threshold)
    vocabulary = sorted({r[2] for r in rows})
    counts = word_frequencies(texts)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets: dict[int, list[str]] = {}
    for i, _, w, *_ in rows:
        sets.setdefault(i, []).append(w)
    place = {(i, w): k for i, ws in sets.items() for k, w in enumerate(sorted(ws, key=rank.get))}
    out = [(i, label, w, size, need, telling, rank[w], place[i, w]) for i, label, w, size, need, telling in rows]
    return texts.sparkSession.createDataFrame(out, "template int, label string, word string, size int, need int, telling boolean, rank int, place int")


def in_reach(own: str, need: Column, width: Column) -> Column:
    """(i, at) of the places of own (array<struct<at, word>>, in order) from which on the need-th place is less than width words away: a
    window that starts at another one has too few words left to hold need different ones."""
    last = lambda x, i: F.coalesce(F.get(own, i + need - 1)["at"] < x["at"] + width, F.lit(False))
    return F.array_compact(F.transform(own, lambda x, i: F.when(last(x, i), F.struct(i.alias("i"), x["at"].alias("at")))))


def matching_blocks(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """(digest, block, label, containment) of the best block, by the place of its first word, of every
    text of texts (digest, held) for every template whose threshold it meets."""
    prefix = templates.where(F.col("place") <= F.col("size") - F.col("need")).select("word", "template")
    tokens = texts.select("digest", "held", F.explode(F.array_distinct("held.word")).alias("word"))
    candidates = tokens.join(F.broadcast(prefix), "word").drop("word").dropDuplicates(["digest", "template"])  # as small as the templates are
    whole = templates.groupBy("template", "label", "size", "need").agg(F.collect_set("word").alias("whole"), F.collect_set(F.when(F.col("telling"), F.col("word"))).alias("telling"))
    own = F.filter("held", lambda x: F.array_contains("whole", x["word"])).alias("own")
    enough = F.size(F.array_intersect("held.word", "whole")) >= F.col("need")
    pairs = candidates.join(F.broadcast(whole), "template").where(enough).select("digest", "label", "size", "need", "telling", own)
    width = F.col("size") * WIDTH
    pairs = pairs.withColumn("starts", in_reach("own", F.col("need"), width)).where(F.size("starts") > 0)

    def block(x: Column) -> Column:
        inside = F.filter(F.slice("own", x["i"] + 1, width), lambda y: y["at"] < x["at"] + width)
        shared = F.array_distinct(F.transform(inside, lambda y: y["word"]))
        told = F.size(F.array_intersect(shared, "telling")) == F.size("telling")
        return F.struct(F.when(told, F.size(shared)).otherwise(0).alias("shared"), (-x["at"]).alias("back"))

    best = pairs.select("digest", "label", "size", "need", F.array_max(F.transform("starts", block)).alias("best"))
    return best.where(F.col("best.shared") >= F.col("need")).select("digest", (-F.col("best.back")).alias("block"), "label", (F.col("best.shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): words, base places and labels, and labels with those
    of the matching blocks; score is the best containment of a block, 0 without one.

    Null texts are empty; null ids and repeated rows are kept; texts of any length are read whole; an
    empty table gives an empty result; other columns are not read."""
    # with only known words left, a small table
    read = stored(with_places(docs, templates), "license-words")
    texts = read.select("digest", "held").where(F.size("held") > 0)
    # only texts with a match give rows here: few, and as many for copies as for one
    blocks = matching_blocks(texts, ordered_templates(texts, templates, threshold))
    found = blocks.groupBy("digest").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    base = read.select("doc_id", "digest", "n_words", F.array(*(phrase_places(F.col("held"), p) for p, _ in PHRASES)).alias("_places"))
    joined = base.join(found, "digest", "left")
    starts = F.flatten("_places")
    labels = F.array_compact(F.array(*(F.when(F.size(F.col("_places")[i]) > 0, label) for i, (_, label) in enumerate(PHRASES))))
    both = F.array_union(labels, F.coalesce("found", F.array().cast("array<string>")))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return joined.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(labels).alias("base_labels"), join(both).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
