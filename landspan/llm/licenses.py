"""License scan: phrases, and an exact set-similarity join with templates (operator 10).

*Base.* Places where the words of a phrase stand one after the other.

*Method.* A template is a license text of k words. Text blocks are the lines of a document and,
whatever its line breaks, all its windows of k / ``CONTAINMENT`` words; blocks and templates are
sets of words. A block matches a template when it holds ``CONTAINMENT`` of the template's words.
Of the windows, those around a prefix word with enough words of the template go to the join,
each for its template only. Words are put in one
global order, rare ones first by the number of blocks of all documents that hold them. A template
of n words, a of which are needed, has a match only among blocks that hold one of its n - a + 1
rarest words (prefix), that hold enough words of templates at all (length), and in which enough
words follow that one in the order (position). What passes is counted in full.

Templates and phrases are parameters of fixed size; the table of word counts has a row for each
word of a template at most.

Null texts are empty and have no labels. Ties of frequency are ordered by the word. Repeated rows
are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.tables import row_key
from landspan.workspace import materialize

PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Sentences by which licenses are granted.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8

# A-Z to a-z, digits and non-ASCII bytes as they are, line breaks kept, the rest to spaces.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32
    for b in range(256))


def words_of(text: str) -> list[str]:
    """Words of a text, A-Z in lower case."""
    return [w.decode() for w in text.encode().translate(_WORDS).split()]


def _block_counts(texts: DataFrame, vocabulary: list[bytes]) -> dict[str, int]:
    """How many lines of all documents hold each word of the vocabulary."""
    known = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in text.encode().translate(_WORDS).split(b"\n"):
                    counts.update(known.intersection(line.split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()),
             pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, int, str]]:
    """First word, last word and label of each place of each phrase."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        pattern = b" " + b" ".join(phrase) + b" "
        at = joined.find(pattern)
        while at >= 0:
            first = joined.count(b" ", 0, at)
            out.append((first, first + len(phrase) - 1, label))
            at = joined.find(pattern, at + 1)
    return out


_SCANNED = ("key_id long, key_tag long, doc_id long, n_words long, n_base long, first_word long, "
            "last_word long, base_labels array<string>, "
            "blocks array<struct<template: int, ranks: array<int>>>")


def _windows(places: list[int], ranks: list[int], held: frozenset[int], heads: frozenset[int],
             needed: int, width: int) -> set[tuple[int, ...]]:
    """Ranks of a template in each window of so many words that could match it.

    places, ranks: where words of templates stand, ascending, and which. Windows that begin at a
    word of the template are enough: moved there, a window loses none of its words.
    """
    own = [(p, r) for p, r in zip(places, ranks, strict=True) if r in held]
    found, done = set(), 0
    for k, (place, rank) in enumerate(own):
        if rank not in heads:
            continue
        first = k
        while first > done and own[first - 1][0] > place - width:
            first -= 1
        for begin in range(first, k + 1):
            end = bisect_left(own, (own[begin][0] + width,), begin)
            if end - begin >= needed and len(window := {r for _, r in own[begin:end]}) >= needed:
                found.add(tuple(sorted(window)))
        done = k + 1
    return found


def _scan(phrases: list[tuple[list[bytes], str]], order: dict[bytes, int], heads: frozenset[bytes],
          templates: list[tuple[int, frozenset[int], frozenset[int], int, int]]):
    """Places of phrases, and the lines and windows that hold a word of a template's prefix.

    Of such a block, the places in the global order of the template words it holds; of a window
    also the template it is for. templates: id, ranks, ranks of the prefix, needed, width.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(3).to_pylist():
                plain = text.encode().translate(_WORDS)
                words = plain.split()
                places = _places(words, phrases)
                blocks = []
                if not heads.isdisjoint(words):
                    for line in plain.split(b"\n"):
                        held = set(line.split())
                        if not heads.isdisjoint(held):
                            blocks.append((None, sorted(order[w] for w in held if w in order)))
                    met = [(k, order[w]) for k, w in enumerate(words) if w in order]
                    at, ranks = [k for k, _ in met], [r for _, r in met]
                    present = frozenset(ranks)
                    for template, held, first, needed, width in templates:
                        if not first.isdisjoint(present) and len(held & present) >= needed:
                            blocks += [(template, list(x)) for x in _windows(
                                at, ranks, held, first, needed, width)]
                row = (len(words), len(places), min((p[0] for p in places), default=None),
                       max((p[0] for p in places), default=None),
                       sorted({p[2] for p in places}), [{"template": k, "ranks": r} for k, r in blocks])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct(
                [("template", pa.int32()), ("ranks", pa.list_(pa.int32()))]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, columns, types)],
                names=["key_id", "key_tag", "doc_id", "n_words", "n_base", "first_word", "last_word",
                       "base_labels", "blocks"])

    return run


def set_join(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """Blocks joined to the templates they contain: all block columns, template_id, containment.

    blocks: block_id, ranks. templates: template_id, ranks, needed. Ranks are places in the
    global order, ascending and distinct. The templates are a table of fixed size.
    """
    entries = templates.select(
        "template_id", "needed", F.col("ranks").alias("template"),
        F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("needed") + 1)).alias("i", "rank"))
    probes = blocks.where(F.size("ranks") > 0).select("*", F.posexplode("ranks").alias("j", "rank"))
    left = lambda of, at: F.size(of) - F.col(at)
    passed = probes.join(F.broadcast(entries), "rank").where(
        (F.size("ranks") >= F.col("needed"))
        & (F.least(left("template", "i"), left("ranks", "j")) + F.least("i", "j") >= F.col("needed")))
    shared = F.size(F.array_intersect("ranks", "template"))
    return passed.where(shared >= F.col("needed")).withColumn(
        "containment", shared / F.size("template")).drop("i", "j", "rank", "needed", "template").distinct()


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document row."""
    spark = docs.sparkSession
    rows = docs.select(*row_key(), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = [(label, sorted({w.encode() for w in words_of(text)})) for label, text in templates]
    counts = _block_counts(rows, sorted({w for _, held in sets for w in held}))
    in_order = sorted({w for _, held in sets for w in held}, key=lambda w: (counts.get(w.decode(), 0), w))
    order = {w: k for k, w in enumerate(in_order)}
    ranked = [(k, label, sorted(order[w] for w in held), math.ceil(containment * len(held)))
              for k, (label, held) in enumerate(sets)]
    heads = frozenset(in_order[r] for _, _, ranks, needed in ranked
                      for r in ranks[:len(ranks) - needed + 1])
    wanted = [([w.encode() for w in words_of(text)], label) for text, label in phrases]
    sized = [(k, frozenset(ranks), frozenset(ranks[:len(ranks) - needed + 1]), needed,
              math.ceil(len(words_of(text)) / containment))
             for (k, _, ranks, needed), (_, text) in zip(ranked, templates, strict=True) if ranks]
    scanned = materialize(rows.mapInArrow(_scan(wanted, order, heads, sized), _SCANNED), "licenses")
    table = spark.createDataFrame(ranked, "template_id int, label string, ranks array<int>, needed int")
    found = set_join(
        scanned.select("key_id", "key_tag", F.explode("blocks").alias("block")).select(
            "key_id", "key_tag", F.col("block.template").alias("only"), "block.ranks").distinct(),
        table.drop("label")).where("only is null or only = template_id")
    own = found.join(F.broadcast(table.select("template_id", "label")), "template_id").groupBy(
        "key_id", "key_tag").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>"))))
    return scanned.join(own, ["key_id", "key_tag"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Labels of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
