"""License scan by diagonal voting, with DataFrame operations only.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII letters
lower-cased. Every k words of a text are hashed and joined to the k-grams of license
templates. A hit votes for its diagonal, text position minus template position: a
template that stands in the text unchanged puts all votes on one diagonal, an inserted
or missing word moves the rest to a neighbouring one. Votes are summed by document,
template and diagonal, diagonals at most ``slack`` apart are merged, and a merged span is
verified: the words its hits cover must be ``cover`` of the template's words, and the
span may not be longer than the template by more than ``stretch``.

The template table is a parameter; its grams are counted before they are broadcast, and
beyond ``BROADCAST_GRAMS`` the join is a shuffled one. Exploded grams stream through the
broadcast join, so only hits are exchanged; they are keyed by document.

Defined results: null and empty texts have no words and no labels; every input row gives
one result row, and rows with equal (doc_id, text) equal ones; a text shorter than k
words can only have base labels; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases whose places are counted, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# License notices by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

BROADCAST_GRAMS = 100_000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = "(?<= )(?:" + "|".join(BASE) + ")(?= )"


def words_of(text: Column) -> Column:
    """The words, as an array."""
    lower = F.translate(F.coalesce(text, F.lit("")), _LETTERS, _LETTERS.lower())
    return F.array_remove(F.split(lower, _BETWEEN), "")


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; element i is the run from word i on."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    )
    return F.when(F.size(words) >= k, runs)


def template_grams(spark, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, size, place, gram) of all templates."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, notice string")
    words = table.select("template", "label", words_of(F.col("notice")).alias("_w"))
    return words.select("template", "label", F.size("_w").alias("size"), F.posexplode(gram_hashes(F.col("_w"), k)).alias("place", "gram"))


def base_places(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels of every row."""
    words = docs.withColumn("_words", words_of(F.col("text")))
    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    rows = words.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"), joined.alias("_joined"))
    has = {label: F.contains("_joined", F.lit(f" {phrase} ")) for phrase, label in BASE.items()}
    rows = rows.withColumn("_labels", F.array_compact(F.array(*[F.when(h, F.lit(label)) for label, h in has.items()])))
    some = F.size("_labels") > 0

    def word_before(match: str) -> Column:
        lead = F.regexp_extract("_joined", f"(?s)^({match}){_PHRASES}", 1)
        return F.when(some, F.length(lead) - F.length(F.replace(lead, F.lit(" "), F.lit(""))) - 1).cast("long")

    return rows.select(
        "doc_id", "_text", "n_words",
        F.when(some, F.regexp_count("_joined", F.lit(_PHRASES))).otherwise(0).cast("long").alias("n_base"),
        word_before(".*?").alias("first_word"), word_before(".*").alias("last_word"),
        F.array_sort("_labels").alias("base_labels"),
    )


def spans(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    k: int = 3,
    slack: int = 2,
    cover: float = 0.8,
    stretch: float = 0.5,
) -> DataFrame:
    """Verified spans: (doc_id, _text, template, label, first, last, covered share)."""
    spark = docs.sparkSession
    table = template_grams(spark, templates, k)
    if table.count() <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    # The words are a column of their own: inside the lambda they would be split again for each run.
    words = docs.select("doc_id", "_text", words_of(F.col("text")).alias("_words"))
    runs = words.select("doc_id", "_text", F.posexplode(gram_hashes(F.col("_words"), k)).alias("at", "gram"))
    hits = runs.join(table, "gram")
    key = ["doc_id", "_text", "template", "label", "size"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )  # a diagonal has at most one hit per place of the template
    group = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(group) > slack
    runs_of = votes.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int"))
    # Neighbouring diagonals far apart in the text are separate spans.
    runs_of = runs_of.withColumn("_span", F.sum("_new").over(group))
    merged = runs_of.groupBy(*key, "_span").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.min("first").alias("first"), (F.max("last") + k).alias("last"),
    )
    # Words covered: every hit covers k words, less what the next hit covers again.
    ahead = F.transform("places", lambda p, i: F.coalesce(F.get("places", i + 1) - p, F.lit(k)))
    covered = F.aggregate(ahead, F.lit(0), lambda total, gap: total + F.least(gap, F.lit(k)))
    share = (covered / F.col("size")).alias("share")
    fits = F.col("last") - F.col("first") <= F.col("size") * (1 + stretch) + slack
    return merged.select(*key, "first", "last", share).where(fits & (F.col("share") >= cover))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = 3) -> DataFrame:
    """One row per input row: counts and places of base phrases, labels, and a score."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.xxhash64(F.lit(1), "text"), F.lit(0)).alias("_text"),
    )
    found = spans(rows, templates, k).groupBy("doc_id", "_text").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("best")
    )
    found = found.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"), "found", "best")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of"))
    every = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.least("best", F.lit(1.0)), F.lit(0.0)))
    return base_places(rows).join(found, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        score.cast("double").alias("score"),
    )
