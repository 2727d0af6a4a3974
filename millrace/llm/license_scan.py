"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's *header* statements are its lines that speak of a licence, wherever they are, and the
windows of words about each such word, which run on over the ends of lines and lie inside long ones.
Each is compared with the templates by the cosine of sparse TF-IDF vectors of
its words, a line with all of them, a window (``WINDOWS``) with those no longer than itself; the best one from
``HEADER_COSINE`` or the window's least cosine on is the file's own licence.  A file is a
*licence file* of its directory where it has a telling name, or where its whole text's
cosine reaches ``FILE_COSINE``.  A file without a licence of its own takes that of
the nearest directory above it: the distinct directories of such files are joined with those that have
licence files, one row an ancestor, the deepest match wins, and the files are joined with their directory's.

Inverse document frequencies are those of the templates, a table of fixed size; a
word in no template weighs as much as the rarest.

All of it is DataFrame operations.  Defined cases: null or empty texts have no licence
of their own; a null path has no directories; of equal cosines the licence
first in the alphabet wins, of several licence files in a directory the best
match; rows repeat as they come; an empty table stays empty; further columns are ignored.
A very long text is read whole; its windows are as many as the words that speak of a licence ask for.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stash

HEADER_COSINE, FILE_COSINE = 0.45, 0.35
#: What speaks of a licence, and the words about which windows are laid; each template has one.
MARK = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved|copying|redistribution|permission|unencumbered"
MARK_WORD = r"^(?:licen[cs]e.*|copyright.*|spdx|copying|redistribution|permission|unencumbered)$"
#: Windows as (words, step, least cosine): one of s words and step t holds every statement of s - t + 1 words whole.
#: Those that a short statement fills must be near to all of it.
WINDOWS = [(4, 1, 0.8), (5, 1, 0.8), (6, 1, 0.8), (7, 1, 0.8), (14, 2, 0.6), (18, 3, 0.6), (24, 4, 0.6), (44, 6, 0.6), (54, 8, 0.6)]
FILE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([-._].*)?$"

# Statements by which licences are named, some for each.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0 public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
]
NOT_A_WORD = r"[^a-z0-9.]+"


def template_words(text: str) -> list[str]:
    """As :func:`words_of`, for the templates."""
    cleaned = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789." else " " for c in text.lower())
    return [w for w in (w.strip(".") for w in cleaned.split()) if w]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and inner dots."""
    words = F.transform(F.split(F.lower(text), NOT_A_WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: w != "")


def template_table(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of a word in no template, and the templates' unit vectors."""
    counts = [Counter(template_words(t)) for _, t in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = []
    for c in counts:
        v = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    return idf, math.log(1 + len(counts)) + 1, vectors


def best_templates(spark: SparkSession, units: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The keys, licence and score of the template with the largest cosine to each unit's ``words``.

    ``size``, one of the keys: only templates of at most so many words are compared; null: all of them.
    """
    idf, unseen, vectors = template_table(templates)
    table = F.broadcast(spark.createDataFrame([(w, x, [v.get(w, 0.0) for v in vectors]) for w, x in sorted(idf.items())], "word string, idf double, weights array<double>"))
    words = units.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("tf"))
    words = words.join(table, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    sums = words.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("__xx"), *[F.sum(F.col("x") * F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(f"__{k}") for k in range(len(vectors))])
    compared = [F.coalesce(F.col("size") >= len(template_words(text)), F.lit(True)) for _, text in templates]
    scored = [F.struct(F.when(fits, F.round(F.col(f"__{k}") / F.sqrt("__xx"), 6)).otherwise(0.0).alias("score"), F.lit(name).alias("licence")) for k, ((name, _), fits) in enumerate(zip(templates, compared, strict=True))]
    better = lambda a, b: F.when((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["licence"] < a["licence"])), b).otherwise(a)
    best = F.aggregate(F.array(*scored[1:]), scored[0], better)
    return sums.withColumn("__best", best).select(*keys, F.col("__best.licence").alias("licence"), F.col("__best.score").alias("score"))


def windows(words: Column) -> Column:
    """Array of (size, at, words): the windows that hold a word that speaks of a licence, each once."""
    marks = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(MARK_WORD), i)), lambda i: i.isNotNull())
    out = []
    for size, step, _ in WINDOWS:
        first = lambda i: F.greatest(F.ceil((i - (size - 1)) / step), F.lit(0)).cast("int") * step  # noqa: B023, E731
        starts = F.array_distinct(F.flatten(F.transform(marks, lambda i: F.sequence(first(i), F.floor(i / step).cast("int") * step, F.lit(step)))))  # noqa: B023
        out.append(F.transform(starts, lambda at: F.struct(F.lit(size).alias("size"), at.alias("at"), F.slice(words, at + 1, size).alias("words"))))  # noqa: B023
    return F.concat(*out)


def directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def ancestors(folder: Column) -> Column:
    """Array of (dir, depth): a directory and those above it, '' at depth 0 among them."""
    parts = F.filter(F.split(folder, "/"), lambda p: (folder != "") | (p != ""))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(F.array_join(F.slice(parts, 1, d), "/").alias("dir"), d.alias("depth")))


def scan(files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text", header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """Rows (doc_id, path, licence, score, how, licence_dir): how is 'own' or 'inherited', or null where no licence is found."""
    spark = files.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    speaks = text.rlike(MARK)
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: s.rlike(MARK))
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(path_column).alias("path"), F.when(speaks, lines).alias("lines"), F.when(speaks, words_of(text)).alias("words"))
    rows = stash(rows, "licence-lines")
    better = F.struct(F.col("score"), -F.col("order")).alias("rank")
    order = {name: i for i, name in enumerate(sorted({n for n, _ in TEMPLATES}))}
    place = F.coalesce(*[F.when(F.col("licence") == n, F.lit(i)) for n, i in order.items()])
    none = F.lit(None).cast("int")
    least = F.coalesce(*[F.when(F.col("size") == size, F.lit(cosine)) for size, _, cosine in WINDOWS], F.lit(header_cosine))
    units = rows.select("row", F.posexplode("lines").alias("at", "line")).select("row", none.alias("size"), "at", words_of(F.col("line")).alias("words"))
    units = units.unionByName(rows.where("words IS NOT NULL").select("row", F.explode(windows(F.col("words"))).alias("w")).select("row", "w.size", "w.at", "w.words"))
    own = best_templates(spark, units, ["row", "size", "at"]).where(F.col("score") >= least).withColumn("order", place)
    own = stash(own.groupBy("row").agg(F.max_by(F.struct("licence", "score"), better).alias("b")).select("row", "b.*"), "licence-headers")
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    whole = best_templates(spark, rows.where("words IS NOT NULL").select("row", none.alias("size"), "words"), ["row", "size"]).drop("size")
    whole = whole.withColumnRenamed("licence", "whole_licence").withColumnRenamed("score", "whole_score")
    marked = rows.where("words IS NOT NULL AND path IS NOT NULL").select("row", "path", named.alias("named")).join(whole, "row").join(own, "row", "left")
    marked = marked.where((F.col("whole_score") >= file_cosine) | (F.col("named") & F.col("licence").isNotNull()))
    marked = marked.select(directory(F.col("path")).alias("dir"), F.coalesce("licence", "whole_licence").alias("licence"), F.coalesce("score", "whole_score").alias("score"))
    dirs = stash(marked.withColumn("order", place).groupBy("dir").agg(F.max_by(F.struct("licence", "score"), better).alias("b")).select("dir", "b.*"), "licence-dirs")
    known = rows.select("row", "doc_id", "path").join(own, "row", "left").withColumn("folder", F.when(F.col("licence").isNull(), directory(F.col("path"))))
    folders = known.where("folder IS NOT NULL").select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.dir", "a.depth")
    found = folders.join(dirs, "dir").groupBy("folder").agg(F.max_by(F.struct("licence", "score", "dir"), "depth").alias("i"))
    out = known.join(found, "folder", "left")
    return out.select("doc_id", "path", F.coalesce("licence", "i.licence").alias("licence"), F.coalesce("score", "i.score").alias("score"), F.when(F.col("licence").isNotNull(), "own").when(F.col("i").isNotNull(), "inherited").alias("how"), F.when(F.col("licence").isNull(), F.col("i.dir")).alias("licence_dir"))
