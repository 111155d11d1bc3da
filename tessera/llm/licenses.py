"""License scans by diagonal voting (DataFrame operations only).

Every run of three words of every text meets the runs of the license templates. A run at word p of the text and
word t of a template votes for the diagonal p - t, on which the template lies if it
begins at word p - t. Neighbouring diagonals are merged where words are missing or added, and what the
votes of a span cover is held against the whole template.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Words of a run.
K = 3
#: A template of so many words may miss or add one word for each such number, which moves the diagonal.
SLACK = 8
#: Share of a template's words that a span has to cover. Phrases shorter than SLACK words must stand in full.
COVER = 0.75
#: A word: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are counted, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices and phrases of well-known licenses, with their labels.
MORE = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software"""),
    ("apache-2", """you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0"""),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation"""),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
        above copyright notice and this permission notice appear in all copies"""),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def templates(spark: SparkSession, more: tuple[tuple[str, str], ...] = MORE) -> DataFrame:
    """A row for each run of each template: tpl, label, base, size, slack, at and its words. A few hundred rows, whatever the texts."""
    rows = []
    for tpl, (label, text) in enumerate((*BASE, *more)):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(tpl, label, tpl < len(BASE), len(words), len(words) // SLACK, at, *words[at : at + K]) for at in range(len(words) - K + 1)]
    names = ", ".join(f"t{i} string" for i in range(K))
    return spark.createDataFrame(rows, f"tpl int, label string, base boolean, size int, slack int, at int, {names}")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[tuple[str, str], ...] = MORE) -> DataFrame:
    """Returns a row for each row of docs: doc_id, n_words, spans, score.

    * spans has, by start, a struct (start, stop, label, base, share) for each place of a license: word
      positions from 0, stop exclusive, share the part of the template's words that the text has there in
      order. Base phrases and other short ones stand word by word (share 1), each place for itself; longer
      templates need a share of COVER.
    * score is the largest share of any template, found or not, and 0 where no run of words is shared.
    * A null text is the empty text: no words, no spans, score 0. Rows that repeat an id are scanned each
      on its own, a null id is passed through, texts may have any length; an empty table gives an empty
      result, and other columns are not read.
    * All runs of all texts meet the templates by a hash join. Only the templates' runs are broadcast, as many as the constants above
      give. A group is a template's votes in one text. Votes that a text repeats on one diagonal can be only
      as many as the template has words; places are numbered by a window over the text's own votes.
    """
    spark = docs.sparkSession
    # lower() changes letters beyond A-Z too, which no template has, but for the Kelvin sign, which would become a k
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    words = F.filter(F.split(text, BREAK, -1), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("w"))
    each = rows.select("doc_id", "row", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "w0"))
    runs = each.select("doc_id", "row", "n_words", "pos", "w0", *(F.get("w", F.col("pos") + i).alias(f"w{i}") for i in range(1, K)))
    known = templates(spark, more)
    met = runs.join(F.broadcast(known), [F.col(f"w{i}") == F.col(f"t{i}") for i in range(K)], "left")
    # a text's first word stands for the text; other words go unless they vote
    votes = materialize(
        met.where("tpl IS NOT NULL OR coalesce(pos, 0) = 0").select("doc_id", "row", "n_words", "pos", "tpl", "label", "base", "size", "slack", "at"), "license-votes"
    )
    diagonals = votes.where("tpl IS NOT NULL").withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("row", "tpl", "label", "base", "size", "slack", "diagonal").agg(F.collect_set("at").alias("ats"))
    along = W.partitionBy("row", "tpl").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    places = diagonals.withColumn("place", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    covered = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda t: F.sequence(t, t + (K - 1)))))
    first, last = F.col("diagonal") + F.array_min("ats"), F.col("diagonal") + F.array_max("ats") + K
    spans = places.groupBy("row", "tpl", "label", "base", "size", "place").agg(
        F.min(first).alias("start"), F.max(last).alias("stop"), (F.size(covered(F.flatten(F.collect_list("ats")))) / F.col("size")).alias("share")
    )
    span = F.struct("start", "stop", "label", "base", "share")
    found = F.array_sort(F.collect_list(F.when((F.col("share") >= COVER) & ((F.col("size") >= SLACK) | (F.col("share") == 1)), span)))
    per_row = spans.groupBy("row").agg(found.alias("spans"), F.max("share").alias("score"))
    texts = votes.where("coalesce(pos, 0) = 0").select("row", "doc_id", "n_words").distinct()
    none = F.array().cast("array<struct<start:int,stop:int,label:string,base:boolean,share:double>>")
    return texts.join(per_row, "row", "left").select(
        "doc_id", F.greatest("n_words", F.lit(0)).cast("bigint").alias("n_words"), F.coalesce("spans", none).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def digest_licenses(scans: DataFrame) -> DataFrame:
    """Scans as rows of doc_id, n_words, n_base, first_word, last_word (of base places), base_labels, labels, score."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))
    return scans.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed("spans").alias("labels"), "score",
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all whole documents."""
    return digest_licenses(scan_licenses(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The same rows in DuckDB: base places by comparing lists of words, others by joining words with the templates' words."""
    listed = ", ".join(f"({i}, '{label}', {str(i < len(BASE)).lower()}, '{' '.join(text.split())}')" for i, (label, text) in enumerate((*BASE, *MORE)))
    return rf"""
WITH t(tpl, label, base, text) AS (VALUES {listed}),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
b AS (
  SELECT row, label, p - 1 AS p FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN (SELECT label, string_split(text, ' ') AS tw FROM t WHERE base) y
  ON x.w[p] = y.tw[1] AND x.w[p:p + len(tw) - 1] = tw
),
g AS (SELECT row, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS run, p - 1 AS p FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
k AS (SELECT tpl, label, len(tw) AS size, tw[i] || ' ' || tw[i + 1] || ' ' || tw[i + 2] AS run, i - 1 AS o FROM (SELECT *, unnest(range(1, len(tw) - 1)) AS i FROM (SELECT tpl, label, string_split(text, ' ') AS tw FROM t))),
v AS (SELECT row, tpl, label, size, p - o AS diagonal, o FROM g JOIN k USING (run)),
m AS (
  SELECT *, sum(CASE WHEN gap > size // {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY row, tpl ORDER BY diagonal) AS place
  FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, tpl ORDER BY diagonal) AS gap FROM (SELECT DISTINCT row, tpl, label, size, diagonal FROM v))
),
s AS (
  SELECT row, tpl, label, size, place, count(DISTINCT o + i) / size AS share FROM m JOIN v USING (row, tpl, label, size, diagonal), range(0, {K}) AS x(i)
  GROUP BY row, tpl, label, size, place
),
l AS (SELECT row, label FROM s WHERE share >= {COVER} AND (size >= {SLACK} OR share = 1) UNION SELECT row, label FROM b)
SELECT doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM b WHERE b.row = d.row) AS n_base, (SELECT min(p) FROM b WHERE b.row = d.row) AS first_word, (SELECT max(p) FROM b WHERE b.row = d.row) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM b WHERE b.row = d.row), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM l WHERE l.row = d.row), '') AS labels,
  coalesce((SELECT max(share) FROM s WHERE s.row = d.row), 0)::DOUBLE AS score
FROM d
"""


OP11_SQL = _sql()
