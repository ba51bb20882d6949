"""Operator 13: license scan by an exact set-similarity join of text blocks with templates.

Blocks. A text's words are cut into windows of 16, 32, 64 and so on words, each half
overlapped by the next. A template is sought in the windows of the least width that is
at least twice its words, so a passage as long as the template lies whole in one window.
A window matches when it holds at least ``THRESHOLD`` of the template's distinct words,
those among them that the template marks as required.

Join. The words of all templates are counted over the whole corpus; their sets are put in
that order, rarest first. A window that matches shares at least one of the first
``size - need + 1`` words of the template (prefix filter), has at least ``need`` template
words (length filter), and leaves, from the places that a shared word takes in both sets,
room for ``need`` shared ones (positional filter). The filters remove no match. What passes
is compared set by set. Tasks only make windows around prefix words, so a text without
them costs one look-up a word.

The join, the duplicates of its pairs and the labels of a document are DataFrame work on
keys; sets are fetched for candidates alone. Templates are a parameter that the driver
holds like a tokenizer's vocabulary; nothing else is sent to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.store import Kept, keep, ship

THRESHOLD = (8, 10)
NARROWEST = 16
BATCH = 512

# --- fixed values: the phrases every scan counts, and their labels -------------
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# --- a parameter: characteristic passages of public licenses and their notices; a word
# after "=" tells one license from its likes and must be in the window --------------
TEMPLATES = (
    ("mit", "released under the =mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the =apache license version =2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version =2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version =3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu =lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "you should have received a copy of the gnu =affero general public license along with this program"),
    ("mpl-2.0", "this source code form is subject to the terms of the =mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "this work is licensed under a creative commons =attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by =nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by =sa 4 0"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced without prior written permission"),
)

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return (data or b"").translate(_WORDS).split()


def width_for(n_words: int) -> int:
    """The least window width, 16 times a power of two, of at least twice so many words."""
    width = NARROWEST
    while width < 2 * n_words:
        width *= 2
    return width


@dataclass(frozen=True)
class Template:
    label: str
    width: int
    need: int
    words: frozenset[bytes]
    must: frozenset[bytes]


def templates_of(pairs, threshold: tuple[int, int] = THRESHOLD) -> list[Template]:
    """The templates of ``(label, text)`` pairs; one without words matches nothing and goes."""
    out = []
    for label, text in pairs:
        words = words_of(text.encode())
        if words:
            size = len(set(words))
            must = [w for part in text.split() if part.startswith("=") for w in words_of(part.encode())]
            out.append(Template(label, width_for(len(words)), -(-threshold[0] * size // threshold[1]), frozenset(words), frozenset(must)))
    return out


@dataclass(frozen=True)
class Index:
    """What tasks need: the template words by rank, and the prefix words of every width."""

    ranks: dict[bytes, int]
    prefixes: dict[int, np.ndarray]
    phrases: list[tuple[str, list[int]]]


def _counter(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        none = len(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for text in batch.column(0).slice(at, BATCH).to_pylist():
                    words = words_of(text)
                    total += np.bincount(np.fromiter(map(vocabulary.get, words, repeat(none)), np.int64, len(words)), minlength=none + 1)
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["word", "n"])

    return run


def frequencies(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """How often each of ``words`` stands in the texts of ``docs``, over all rows.

    A task gives one row a word, whatever it reads, so the answer is small by its making.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    parts = texts.mapInArrow(_counter({w: i for i, w in enumerate(words)}), "word int, n long")
    out = np.zeros(len(words), dtype=np.int64)
    for word, n in parts.groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


def blocks_of(ranks: np.ndarray, prefixes: dict[int, np.ndarray]) -> list[dict]:
    """The windows that hold a prefix word of their width, with their distinct template words by rank.

    ``ranks`` has the rank of every word of the text, the number of ranks for other words.
    """
    out = []
    for width, is_prefix in prefixes.items():
        at = np.flatnonzero(is_prefix[ranks])
        if len(at):
            half = width // 2
            for number in np.unique(np.concatenate((at // half, at // half - 1))).tolist():
                if number >= 0:
                    found = np.unique(ranks[number * half : number * half + width])
                    out.append({"width": width, "number": number, "words": found[found < len(is_prefix) - 1].tolist()})
    return out


def places(ranks: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of ``phrase`` stand one after the other."""
    n = len(ranks) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(ranks[:n] == phrase[0])
    for i, word in enumerate(phrase[1:], 1):
        at = at[ranks[at + i] == word]
    return at


def _scanner(index: Index):
    block = pa.list_(pa.struct([("width", pa.int32()), ("number", pa.int64()), ("words", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = len(index.ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                counts, base, first, last, labels, blocks = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    ranks = np.fromiter(map(index.ranks.get, words, repeat(none)), np.int64, len(words))
                    found = [(label, x) for label, phrase in index.phrases if len(x := places(ranks, phrase))]
                    counts.append(len(words))
                    base.append(sum(len(x) for _, x in found))
                    first.append(min((int(x[0]) for _, x in found), default=None))
                    last.append(max((int(x[-1]) for _, x in found), default=None))
                    labels.append(sorted({label for label, _ in found}))
                    blocks.append(blocks_of(ranks, index.prefixes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                     pa.array(labels, pa.list_(pa.string())), pa.array(blocks, block)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    return run


def _matches(spark: SparkSession, kept: Kept, sets: DataFrame) -> DataFrame:
    """``row, label, share`` of every window and template that match."""
    blocks = kept.df.select("row", F.explode("blocks").alias("b")).select("row", "b.width", "b.number", "b.words")
    tokens = blocks.select("row", "width", "number", F.size("words").alias("held"), F.posexplode("words").alias("at", "word"))
    first = F.slice("words", 1, F.size("words") - F.col("need") + 1)
    prefix = sets.select("template", "need", F.size("words").alias("size"), F.col("width").alias("of"), F.posexplode(first).alias("place", "rare"))
    # shared words before this one, and from it on
    room = F.least("at", "place") + F.least(F.col("held") - F.col("at"), F.col("size") - F.col("place"))
    pairs = (tokens.join(prefix, (F.col("word") == F.col("rare")) & (F.col("width") == F.col("of")))
             .where((F.col("held") >= F.col("need")) & (room >= F.col("need")))
             .select("row", "width", "number", "template").distinct())
    whole = pairs.join(blocks, ["row", "width", "number"]).join(sets.select("template", "label", "need", "must", F.col("words").alias("wanted")), "template")
    shared = F.size(F.array_intersect("words", "wanted"))
    return whole.where((shared >= F.col("need")) & (F.size(F.array_except("must", "words")) == 0)).select("row", "label", (shared / F.size("wanted")).alias("share"))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Licenses named or quoted in every whole text of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``:
    the words; the places where a phrase's words stand one after the other, the first and
    last of their starts (null without one) and the phrases' labels; these labels and
    those of all templates that some window matches (both distinct, sorted, joined by
    commas); and the greatest share of a template that a matching window holds, 1 where a
    phrase was found, 0 where nothing was.

    Null and empty texts have no words and no labels. Every row comes back once, repeated
    ones and null ids too. Ties in the words' frequency are put in the order of the words. An
    empty table gives no rows. Other columns are not read. A text is held by one task.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = templates_of(templates, threshold)
    asked = [(label, words_of(text.encode())) for text, label in phrases if words_of(text.encode())]
    words = sorted({w for t in wanted for w in t.words} | {w for _, x in asked for w in x})
    counts = frequencies(docs, words)
    ranks = {words[i]: rank for rank, i in enumerate(np.argsort(counts, kind="stable").tolist())}
    sets = [(i, t.label, t.width, t.need, sorted(ranks[w] for w in t.words), sorted(ranks[w] for w in t.must)) for i, t in enumerate(wanted)]
    prefixes = {width: np.zeros(len(ranks) + 1, dtype=bool) for width in sorted({t.width for t in wanted})}
    for _, _, width, need, have, _ in sets:
        prefixes[width][have[: len(have) - need + 1]] = True
    index = Index(ranks, prefixes, [(label, [ranks[w] for w in x]) for label, x in asked])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    scanned = texts.mapInArrow(_scanner(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                                "base array<string>, blocks array<struct<width:int,number:long,words:array<int>>>")
    # the row number is fixed by writing it; doc_id need not be unique
    kept = keep(scanned.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    sets_frame = spark.createDataFrame(sets, "template int, label string, width int, need int, words array<int>, must array<int>")
    matched = _matches(spark, kept, sets_frame).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return kept.df.drop("blocks").join(matched, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"))
