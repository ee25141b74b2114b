"""License scan by diagonal voting.

Every text's words are hashed into rolling k-grams (two words for phrases, four for passages), and the k-grams are joined
to the positions they have in the license templates.  A hit votes for its diagonal, text position less template position.
A phrase stands where one diagonal has the votes of all its k-grams.  For a passage, diagonals at most ``DRIFT`` apart are
merged, so that some inserted or lost words don't split it, and the merged span is verified: the words of the template
under its votes must be at least ``MIN_COVER`` of all, in a span not much longer than the template.

The templates are fixed and few, so their k-grams are broadcast.  Only hits are shuffled, never a text.

Defined results: a NULL text is empty and has no words; repeated rows give a row each, as hits are keyed by id and hash of
the text; a NULL id is an id like another; other columns of the documents are left out.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import FOLDED_BREAK, ascii_lower, split_words

PHRASE_GRAM, PASSAGE_GRAM = 2, 4
DRIFT = 3
MIN_COVER = 0.7
MAX_STRETCH = 1.5
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices of well-known public licenses.
PASSAGES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    gram: int
    base: bool

    @property
    def n_grams(self) -> int:
        return len(self.words) - self.gram + 1


def template_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def templates() -> list[Template]:
    phrases = [(text, label, PHRASE_GRAM, True) for text, label in PHRASES]
    passages = [(text, label, PASSAGE_GRAM, False) for label, text in PASSAGES]
    return [Template(i, label, template_words(text), gram, base) for i, (text, label, gram, base) in enumerate(phrases + passages)]


def rolling_grams(hashes: str, size: int) -> Column:
    """The hashes of all runs of `size` words, by position; `hashes` names a column of word hashes."""
    column, n = F.col(hashes), F.size(hashes)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[column[i + k] for k in range(size)]))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def template_grams(spark: SparkSession, wanted: list[Template]) -> DataFrame:
    """gram, template, at (its position in the template), gram_size."""
    rows = [(t.number, list(t.words), t.gram) for t in wanted]
    parts = []
    for size in (PHRASE_GRAM, PASSAGE_GRAM):
        frame = spark.createDataFrame([r for r in rows if r[2] == size], "template int, words array<string>, gram_size int")
        hashed = frame.select("template", "gram_size", word_hashes(F.col("words")).alias("hashes"))
        parts.append(hashed.select("template", "gram_size", F.posexplode(rolling_grams("hashes", size)).alias("at", "gram")))
    return parts[0].unionByName(parts[1])


def find_licenses(docs: DataFrame, wanted: list[Template] | None = None) -> DataFrame:
    """doc_id, key (hash of the text), template, start, stop (words) and cover of every verified span."""
    wanted = wanted or templates()
    words = docs.select(
        "doc_id", F.xxhash64("text").alias("key"), split_words(ascii_lower(F.col("text")), FOLDED_BREAK).alias("words")
    )
    hashed = words.select("doc_id", "key", word_hashes(F.col("words")).alias("hashes"))
    grams = F.concat(rolling_grams("hashes", PHRASE_GRAM), rolling_grams("hashes", PASSAGE_GRAM))
    n_pairs = F.greatest(F.size("hashes") - (PHRASE_GRAM - 1), F.lit(0))
    each = hashed.select("doc_id", "key", n_pairs.alias("n_pairs"), F.posexplode(grams).alias("pos", "gram"))
    hits = each.join(F.broadcast(template_grams(docs.sparkSession, wanted)), "gram")
    pos = F.when(F.col("gram_size") == PHRASE_GRAM, F.col("pos")).otherwise(F.col("pos") - F.col("n_pairs"))
    hits = hits.select("doc_id", "key", "template", "at", (pos - F.col("at")).alias("diagonal"))
    # A template's length bounds the votes of a diagonal.
    votes = hits.groupBy("doc_id", "key", "template", "diagonal").agg(F.collect_set("at").alias("votes"))
    facts = docs.sparkSession.createDataFrame(
        [(t.number, len(t.words), t.gram, t.gram == PHRASE_GRAM, t.n_grams) for t in wanted],
        "template int, n_words int, gram_size int, phrase boolean, n_grams int",
    )
    votes = votes.join(F.broadcast(facts), "template")
    whole = votes.where(F.col("phrase") & (F.size("votes") == F.col("n_grams"))).select(
        "doc_id", "key", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_words")).alias("stop"), F.lit(1.0).alias("cover")
    )
    by_diagonal = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > DRIFT, F.lit(False))
    runs = votes.where(~F.col("phrase")).withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_diagonal))
    spans = runs.groupBy("doc_id", "key", "template", "run", "n_words", "gram_size").agg(
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("votes")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("votes") + F.col("gram_size")).alias("stop"),
    )
    under = F.array_distinct(F.flatten(F.transform("votes", lambda v: F.sequence(v, v + F.col("gram_size") - 1))))
    spans = spans.withColumn("cover", F.size(under) / F.col("n_words"))
    verified = (F.col("cover") >= MIN_COVER) & (F.col("stop") - F.col("start") <= MAX_STRETCH * F.col("n_words") + DRIFT)
    return whole.unionByName(spans.where(verified).select("doc_id", "key", "template", "start", "stop", "cover"))


def license_digest(docs: DataFrame) -> DataFrame:
    wanted = templates()
    label = F.create_map(*[x for t in wanted for x in (F.lit(t.number), F.lit(t.label))])
    base = F.col("template").isin([t.number for t in wanted if t.base])
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text"))
    found = find_licenses(slim, wanted).withColumn("label", label[F.col("template")])
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = slim.select("doc_id", F.xxhash64("text").alias("key"), F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["key"] == F.col("k")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
