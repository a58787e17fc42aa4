"""License scans by diagonal voting, in DataFrame operations only.

The rolling word 3-gram hashes of all documents are joined to the places of the templates' 3-grams. Each hit votes for
its diagonal, the place in the document less the place in the template. Inserted or missing words move a match to a
neighbouring diagonal, so from each diagonal on those up to DRIFT further are merged into a span, which thus is at most
DRIFT words longer than its template. A span is verified by the template's words that its hits cover, each counted once
however often it is voted for, and reported if these are at least COVER of the template. A base phrase needs all of its
words on one diagonal: they then stand there consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchline.llm.common import table

GRAM, DRIFT, COVER = 3, 4, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases that count as base hits, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licences, by label; words as the scan takes them.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, base, words) of every template."""
    both = [(label, True, phrase) for phrase, label in BASE.items()] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(both)]


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null gives none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, and template, label, base, start, end, score of each verified span.

    A row of docs without a span gives one row with nulls in their place; row tells rows apart even if their ids
    repeat or are null. start and end count the document's words from 0, end exclusive, by the template's whole
    length. Null and empty texts have no words. Other columns aren't read.
    """
    spark = docs.sparkSession
    grams = [(i, label, base, len(w), p, w[p : p + GRAM]) for i, label, base, w in templates() for p in range(len(w) - GRAM + 1)]
    known = spark.createDataFrame(grams, "template int, label string, base boolean, length int, place int, gram array<string>")
    known = known.withColumn("hash", F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(GRAM)))).drop("gram")

    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    starts = F.when(F.size("w") >= GRAM, F.sequence(F.lit(0), F.size("w") - GRAM)).otherwise(F.array().cast("array<int>"))
    # the number of words is told with each gram: a row of Spark's generator would else carry the array that it is taken of
    n_words = F.size("w").cast("long").alias("n_words")
    hashes = F.transform(starts, lambda i: F.struct(n_words, i.alias("at"), F.xxhash64(*(F.get("w", i + j) for j in range(GRAM))).alias("hash")))
    whole = F.struct(n_words, F.lit(-1).alias("at"), F.lit(None).cast("long").alias("hash"))  # stands for the row itself
    rows = rows.select("row", "doc_id", F.inline(F.array_append(hashes, whole)))
    # the templates are constants of this module: a few hundred rows
    voted = rows.join(F.broadcast(known), "hash", "left").where("template is not null or at < 0")
    facts = ("doc_id", "n_words", "label", "base", "length")
    diagonals = voted.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(*(F.first(c).alias(c) for c in facts), F.collect_set("place").alias("places"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    spans = diagonals.withColumn("near", F.when(F.col("base"), F.array("places")).otherwise(F.collect_list("places").over(near)))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten("near"), lambda p: F.sequence(p, p + GRAM - 1))))
    spans = spans.withColumn("score", F.size(covered) / F.col("length"))
    hit = F.col("score") >= F.when(F.col("base"), 1.0).otherwise(COVER)
    spans = spans.where(F.col("template").isNull() | hit)
    return spans.select("row", "doc_id", "n_words", "template", "label", "base", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("length")).cast("long").alias("end"), F.when(F.col("template").isNotNull(), F.col("score")).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row, from license_spans.

    Null and empty texts have no words and no labels. score is the largest covered share of a template among the
    reported spans, else 0.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return license_spans(docs, id_col, text_col).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Runs of GRAM and more equal words of document and template, without hashes or 3-grams."""
    rows = ", ".join(f"({i}, '{label}', {base}, '{' '.join(w)}')" for i, label, base, w in templates())
    return f"""
WITH t0 AS (SELECT *, string_split(words, ' ') w FROM (VALUES {rows}) v(template, label, base, words)),
t AS (SELECT template, unnest(w) word, unnest(range(len(w))) place FROM t0),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
g AS (SELECT rid, unnest(w) word, unnest(range(len(w))) AS spot FROM d),
e AS (SELECT rid, template, spot - place diagonal, place, place - row_number() OVER (PARTITION BY rid, template, spot - place ORDER BY place) run FROM g JOIN t USING (word)),
m AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY rid, template, diagonal, run) >= {GRAM}),
c AS (SELECT a.rid, a.template, a.diagonal, count(DISTINCT m.place) covered FROM (SELECT DISTINCT rid, template, diagonal FROM m) a JOIN t0 USING (template)
 JOIN m ON m.rid = a.rid AND m.template = a.template AND m.diagonal BETWEEN a.diagonal AND a.diagonal + CASE WHEN t0.base THEN 0 ELSE {DRIFT} END GROUP BY ALL),
s AS (SELECT rid, label, base, diagonal, covered / len(w) score FROM c JOIN t0 USING (template) WHERE covered >= len(w) * CASE WHEN base THEN 1 ELSE {COVER} END),
o AS (SELECT rid, count(*) FILTER (base) n_base, min(diagonal) FILTER (base) first_word, max(diagonal) FILTER (base) last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, max(score) score FROM s GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_base, 0)::BIGINT n_base, first_word::BIGINT first_word, last_word::BIGINT last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::DOUBLE score
FROM d LEFT JOIN o USING (rid)
"""


ORACLE_SQL = _oracle()
