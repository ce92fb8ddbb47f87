"""License texts and phrases inside documents, found by voting for diagonals.

Templates are license phrases and passages. All rolling hashes of k words of a document are joined with the places that
templates have them at; each match votes for a diagonal, the place in the document at which the template would begin. The
votes of a diagonal, and those of neighbouring diagonals (words left out or put in), are brought together, and the span they
cover is verified: words that agree, as a share of the template, and no more words around them than ``LOOSE`` allows.

``k`` is three words; a template of fewer has its own length. The templates are constants of this module or an argument, so
their table has a few hundred rows and is broadcast; the words of a match are compared before anything is shuffled.
Only matches, and one row per document, travel. All of it is DataFrame functions.

A base phrase is found where its words stand consecutively, overlapping places included. NULL, empty and wordless texts
have no words and score 0. Equal rows (same key and text) of one input partition are worked out together and returned as
often as they occur; those of other partitions stay apart, so rows that repeat a key meet in no task. Other columns of the
documents do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
# Diagonals at most this far apart are neighbours.
NEAR = 3
# The share of a template's words that has to agree, and the words a span may have, times those of the template.
SHARE = 0.8
LOOSE = 1.5
# Fixed: what parts words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """A phrase or passage in lower case. Exact ones (``base``) count where all words stand consecutively."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text).split()


# The phrases of the contract.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# Passages of public licenses, in their own words.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction"),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
             "provided that the above copyright notice and this permission notice appear in all copies"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
TEMPLATES = (*BASE, *PASSAGES)


def grams(words: Column, k: int) -> Column:
    """The hashes of all runs of ``k`` words, in order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def template_places(spark: SparkSession, templates: Sequence[Template], k: int) -> DataFrame:
    """(gram, template, at, gram_words, length, label, base): where templates have their hashed words."""
    rows = []
    for number, t in enumerate(templates):
        words = t.words
        own = min(k, len(words))
        rows += [(number, i, words[i : i + own], len(words), t.label, t.base) for i in range(len(words) - own + 1)]
    places = spark.createDataFrame(rows, "template int, at int, gram_words array<string>, length int, label string, base boolean")
    sizes = sorted({min(k, len(t.words)) for t in templates})
    gram = F.coalesce(*[F.when(F.size("gram_words") == n, F.element_at(grams(F.col("gram_words"), n), 1)) for n in sizes])
    return places.withColumn("gram", gram)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAPS), lambda w: w != "")


# What tells documents apart after their words are spread: the input partition, the key, and a checksum of the text.
DOCUMENT = ("part", "key", "print")
# The template that stands for a document itself, at a place that no word has.
ITSELF, NOWHERE = -1, -1


def votes(docs: DataFrame, key: str, text: str, templates: Sequence[Template], k: int) -> DataFrame:
    """A row for every place of a document where words of a template stand, and a row for each document itself."""
    rows = docs.select(
        F.spark_partition_id().alias("part"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("print"),
        words_of(F.col(f"`{text}`")).alias("words"),
    )
    sizes = sorted({min(k, len(t.words)) for t in templates})
    found = [F.transform(grams(F.col("words"), n), lambda g, i: F.struct(g.alias("gram"), i.alias("place"))) for n in sizes]
    itself = F.array(F.struct(F.lit(0).cast("long").alias("gram"), F.lit(NOWHERE).alias("place")))
    spread = rows.select(*DOCUMENT, "words", F.size("words").alias("n_words"), F.inline(F.concat(itself, *found)))
    places = template_places(docs.sparkSession, templates, k)
    alone = places.sparkSession.createDataFrame([(ITSELF, 0, [], 1, None, False, 0)], places.schema)
    met = spread.join(F.broadcast(places.unionByName(alone)), "gram")
    agree = F.slice("words", F.col("place") + 1, F.size("gram_words")) == F.col("gram_words")
    right = F.when(F.col("place") == NOWHERE, F.col("template") == ITSELF).otherwise((F.col("template") != ITSELF) & agree)
    return met.where(right).withColumn("diagonal", F.col("place") - F.col("at")).drop("words", "gram", "gram_words", "place")


def spans(voted: DataFrame, k: int, near: int, share: float, loose: float) -> DataFrame:
    """The spans that the votes of neighbouring diagonals cover: (start, end, share, verified) and their template.

    The row of a document itself stays, with its ``copies``.
    """
    what = [*DOCUMENT, "template", "label", "base", "length"]
    diagonals = voted.groupBy(*what, "diagonal").agg(
        F.array_sort(F.collect_set("at")).alias("at"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies")
    )
    order = Window.partitionBy(*what[:4]).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)) | F.col("base")
    numbered = diagonals.withColumn("first", apart.cast("int")).withColumn("span", F.sum("first").over(order))
    own = F.least(F.lit(k), F.col("length"))
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + own - 1)))))
    merged = numbered.groupBy(*what, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.max(covered(F.col("at"))).alias("alone"),
        F.min(F.col("diagonal") + F.element_at("at", 1)).alias("start"),
        F.max(F.col("diagonal") + F.element_at("at", -1) + own).alias("end"),
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
    )
    # A diagonal by itself is never too loose.
    together = F.when(F.col("end") - F.col("start") <= F.col("length") * loose, covered(F.col("at"))).otherwise(0)
    found = merged.withColumn("share", F.greatest("alone", together) / F.col("length"))
    enough = F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(float(share)))
    return found.withColumn("verified", (F.col("share") >= enough) & (F.col("template") != ITSELF))


def licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    k: int = K,
    near: int = NEAR,
    share: float = SHARE,
    loose: float = LOOSE,
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start.
    ``labels`` has those of all verified spans; ``score`` is the largest share of a template that one span agrees with.
    """
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template has two words at least")
    found = spans(votes(docs, key, text, templates, k), k, near, share, loose)
    itself, base = F.col("template") == ITSELF, F.col("base") & F.col("verified")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    per_document = found.groupBy(*DOCUMENT).agg(
        F.max(F.when(itself, F.col("n_words"))).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(~itself, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(itself, F.col("copies"))).alias("copies"),
    )
    return per_document.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"),
    ).drop("__copy")
