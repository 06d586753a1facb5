"""License scans by diagonal voting on rolling word hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, land, registered

#: Letters, digits and everything beyond ASCII; A-Z count as a-z.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of one rolling hash; the shortest phrase has as many.
GRAM = 3
#: Words of the longest template: its positions are bits of one long.
LONGEST = 60
#: Least share of a template's words, or of the span's words if it is longer, that must stand in place.
LEAST_SHARE = 0.75

#: Label and words of the base phrases.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Label, words of a public license notice, and the words in it that must stand unchanged.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version"),
    ("gpl-2", "licensed under the gnu general public license version 2", "license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def _template_rows() -> list[tuple[str, bool, str, int, int]]:
    """Label, whether a base phrase, text, number of words, and as bits the grams that must match."""
    rows = []
    for base, label, text, key in [(True, label, text, text) for label, text in BASE_PHRASES] + [(False, *n) for n in NOTICES]:
        words, needed = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)
        if not GRAM <= len(needed) <= len(words) <= LONGEST:
            raise ValueError(f"a template has {GRAM} to {LONGEST} words, as have its key words: {text}")
        rows.append((label, base, text, len(words), sum(1 << i for i in range(at, at + len(needed) - GRAM + 1))))
    return rows


def _grams(rows: DataFrame, keep: list[str], text: Column, pos: str) -> DataFrame:
    """Every run of ``GRAM`` words as a row: ``keep``, its position, its hash, and the words.

    Letters outside ASCII keep their case: no template has any.
    """
    split = rows.select(*keep, F.regexp_extract_all(text, F.lit(LICENSE_WORD), F.lit(0)).alias("w"))
    n = F.size("w") - GRAM
    places = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    words = [F.lower(F.col("w")[F.col(pos) + i]).alias(f"{pos}_{i}") for i in range(GRAM)]
    return split.select(*keep, "w", F.explode(places).alias(pos)).select(*keep, pos, *words).withColumn("gram", F.xxhash64(*[f"{pos}_{i}" for i in range(GRAM)]))


def template_grams(spark: SparkSession) -> DataFrame:
    """A row per template and position, a few hundred whatever the input: ``t, label, base, n, need, slack, tpos, gram`` and the words."""
    structs = [
        F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("notice"), F.lit(n).alias("n"), F.lit(need).cast("bigint").alias("need"), F.lit(n // 8).alias("slack"))
        for t, (label, base, text, n, need) in enumerate(_template_rows())
    ]
    rows = spark.range(1).select(F.inline(F.array(*structs)))
    return _grams(rows, ["t", "label", "base", "n", "need", "slack"], F.col("notice"), "tpos")


def _covered(mask: str) -> Column:
    """Words covered by the grams of a mask."""
    out = F.col(mask)
    for i in range(1, GRAM):
        out = out.bitwiseOR(F.shiftleft(F.col(mask), i))
    return F.bit_count(out)


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where templates lie in texts: ``doc_id, key, t, label, base, first, end, share, whole, found``.

    Word runs meet template positions in a join on their hashes, the words are compared, and hits of a template vote for
    their diagonal (position in the text minus position in the template). Diagonals closer than an eighth of the template
    merge, since a word put in or left out shifts what follows. ``first`` to ``end`` are the words of the span, ``share``
    the part of the template (or of the span, if longer) that stands in place. ``whole`` is a diagonal that holds all of
    its template: such spans stand on their own and are in the result besides the merged ones. ``found`` spans have
    ``LEAST_SHARE`` and the template's key words. ``key`` is the MD5 of the text: rows that repeat id and text share spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select("doc_id", F.unhex(F.md5("body")).alias("key"), "body")
    templates = F.broadcast(template_grams(docs.sparkSession))
    same = [F.col(f"pos_{i}") == F.col(f"tpos_{i}") for i in range(GRAM)]
    spots = _grams(rows, ["doc_id", "key"], F.col("body"), "pos")
    hits = spots.join(templates, "gram").filter(same[0] & same[1] & same[2])
    of_template = ["t", "label", "base", "n", "need", "slack"]
    votes = hits.groupBy("doc_id", "key", *of_template, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("tpos"))).alias("mask"), F.min("pos").alias("first"), (F.max("pos") + GRAM).alias("end"),
    )
    votes = land(votes, "license-votes")  # read twice: for whole and for merged spans
    in_order = Window.partitionBy("doc_id", "key", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > F.col("slack"), F.lit(True))
    numbered = votes.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(in_order))
    whole = numbered.filter(_covered("mask") == F.col("n")).select("doc_id", "key", "t", "label", "base", "n", "need", "mask", "first", "end", F.lit(True).alias("whole"))
    merged = numbered.filter("not base").groupBy("doc_id", "key", "t", "label", "base", "n", "need", "cluster").agg(
        F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("end").alias("end")
    ).drop("cluster").withColumn("whole", F.lit(False))
    spans = whole.unionByName(merged).withColumn("share", _covered("mask") / F.greatest("n", F.col("end") - F.col("first")))
    found = (F.col("share") >= LEAST_SHARE) & (F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    return spans.withColumn("found", found).drop("mask", "n", "need")


def license_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licenses of every row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the first and last word at
    which one starts. ``labels`` has the base labels and those of the notices found; ``score`` is the largest share of
    any span, also of spans below ``LEAST_SHARE``.

    Null and empty texts have no words, no labels and score 0. Null ids and repeated rows keep their rows. Other columns
    are not read. An empty table gives no rows. A text of any length is taken whole; only hits are shuffled, never words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body)).alias("key"), F.regexp_count(body, F.lit(LICENSE_WORD)).cast("bigint").alias("n_words"),
    )
    place = F.col("base") & F.col("whole")
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")  # noqa: E731  labels of the templates at most
    found = license_spans(docs, doc_id, text).groupBy("doc_id", "key").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("first"))).cast("bigint").alias("last_word"), listed(place).alias("base_labels"), listed(place | F.col("found")).alias("labels"),
        F.max("share").alias("score"),
    ).withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"})
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, '{text}', {n}, {need}::BIGINT, {n // 8})" for t, (label, base, text, n, need) in enumerate(_template_rows()))
    return rf"""
WITH t AS (SELECT t, label, base, string_split(notice, ' ') AS w, n, need, slack FROM (VALUES {values}) v(t, label, base, notice, n, need, slack)
), tg AS (
  SELECT t, label, base, n, need, slack, unnest(range(n - 2)) AS tpos, unnest(list_transform(range(1, n - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM t
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (SELECT doc_id, unnest(range(len(w) - 2)) AS pos, unnest(w[:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM d WHERE len(w) > 2
), v AS (
  SELECT doc_id, t, label, base, n, need, slack, pos - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS mask, min(pos) AS first, max(pos) + 3 AS stop
  FROM dw JOIN tg ON gram = a || ' ' || b || ' ' || c GROUP BY ALL
), x AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS apart FROM v
), c AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS cluster FROM x
), s AS (
  SELECT doc_id, label, base, n, need, mask, first, stop, true AS whole FROM v WHERE bit_count(mask | (mask << 1) | (mask << 2)) = n
  UNION ALL
  SELECT doc_id, label, base, n, need, bit_or(mask), min(first), max(stop), false FROM c WHERE NOT base GROUP BY doc_id, t, label, base, n, need, cluster
), f AS (
  SELECT doc_id, label, base AND whole AS place, first, bit_count(mask | (mask << 1) | (mask << 2)) / greatest(n, stop - first)::DOUBLE AS share, (mask & need) = need AS holds FROM s
), g AS (
  SELECT doc_id, count(*) FILTER (place) AS n_base, min(first) FILTER (place) AS first_word, max(first) FILTER (place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR (holds AND share >= {LEAST_SHARE})) AS labels, max(share) AS score
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@registered("op11_license_scan", _sql())
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(documents(spark, sf_dir))
