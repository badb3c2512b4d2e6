"""Licences by sparse TF-IDF and by directory.

Units of a text are its lines and its paragraphs (runs of lines without an empty
one between) that hold a cue, a word from which "licence", "copyright" and their
kin are made. A unit and a template are vectors of term counts weighted by the
corpus-wide inverse document frequency of the templates' terms; terms that no
template has count as never seen before. The best cosine of ``least`` or more
names a text's own licence. A text without one takes that of the nearest licence
file: the file of that kind with an own licence in the closest directory above.

Everything is DataFrame functions; term counts are rows, so a unit may be of any
length. Null and empty texts have no licence of their own; a null path has no
directory and inherits nothing; among equal cosines the first name, among
licence files of a directory the best cosine and then the smallest path decides; a
null path's text still has its own licence; rows of the same path are each read
for themselves; repeated rows each get their answer, one row a row. Further
columns are kept, but for those of the results' names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.llm.common import Scratch, lookup, text_key

# Licence names with the sentences by which texts grant them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
# How SPDX spells the licences that a file header may name.
SPDX = {
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache-2.0": ("Apache-2.0",), "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",),
    "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC0-1.0": ("CC0-1.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "ISC": ("ISC",),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "MIT": ("MIT",), "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
}
GRANTS = (
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
)
TEMPLATES += tuple(
    (name, f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {terms} as published by the Free Software Foundation, either version {version} of the License, or {choice}any later version.")
    for name, work, terms, version in GRANTS for choice in ("", "(at your option) ")
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {x}") for name, spellings in SPDX.items() for x in spellings)
CUES = ("licen", "copyright", "redistribut", "spdx", "permission", "public domain", "all rights", "free software", "creative commons")
LICENCE_FILES = ("license", "licence", "copying", "unlicense", "notice")
LEAST = 0.6
_SPLIT = "[^a-z0-9.+-]+"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".+-") for x in re.split(_SPLIT, text.lower())) if w]


def words(text: Column) -> Column:
    """The same on a column."""
    return F.filter(F.transform(F.split(F.lower(text), _SPLIT), lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


VOCABULARY = sorted({w for _, t in TEMPLATES for w in words_of(t)})


def units(files: DataFrame) -> DataFrame:
    """text_id, unit: the lines and paragraphs with a cue, each once a row."""
    cue = F.lower("text").rlike("|".join(CUES))
    lines, paragraphs = F.split("text", "\n"), F.split("text", r"\n[\x20\t\r]*\n")
    each = files.where(cue).select("text_id", F.explode(F.array_distinct(F.concat(lines, paragraphs))).alias("unit"))
    return each.where(F.lower("unit").rlike("|".join(CUES)))


def weights(files: DataFrame) -> dict[str, float]:
    """The inverse document frequency of each vocabulary term, and of an unseen one under "": at most len(VOCABULARY) + 1 rows."""
    known = F.array(*map(F.lit, VOCABULARY))
    found = files.select(F.explode(F.concat(F.array_intersect(words(F.col("text")), known), F.array(F.lit("")))).alias("term"))
    df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY} | {"": math.log(n + 1) + 1}


def own_licences(files: DataFrame) -> DataFrame:
    """text_id, licence, cosine: the best template of each text with one of LEAST or more.

    Copies of a text multiply all its counts alike, which leaves its cosines as they are.
    """
    idf = weights(files)
    spark = files.sparkSession
    vectors, norms = [], []
    for k, (_, text) in enumerate(TEMPLATES):
        tf = Counter(words_of(text))
        norms.append(math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items())))
        vectors += [(w, k, c * idf[w]) for w, c in sorted(tf.items())]
    rows = [(w, idf[w], [next((v for x, j, v in vectors if x == w and j == k), 0.0) for k in range(len(TEMPLATES))]) for w in VOCABULARY]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("idf", T.DoubleType()), T.StructField("at", T.ArrayType(T.DoubleType()))])
    terms = F.broadcast(spark.createDataFrame(rows, schema))  # as large as VOCABULARY
    each = units(files).select("text_id", "unit", F.explode(words(F.col("unit"))).alias("term"))
    counts = each.groupBy("text_id", F.xxhash64("unit").alias("unit"), "term").agg(F.count("*").alias("tf"))
    x = counts.join(terms, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(idf[""])))
    dots = [F.sum(F.coalesce(F.col("w") * F.get("at", F.lit(k)), F.lit(0.0))).alias(f"d{k}") for k in range(len(TEMPLATES))]
    x = x.groupBy("text_id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    best = F.array_max(
        F.array(*(F.struct(F.round(F.col(f"d{k}") / (F.col("norm") * F.lit(norms[k])), 9).alias("cosine"), F.lit(-k).alias("k")) for k in range(len(TEMPLATES))))
    )
    names = F.array(*(F.lit(n) for n, _ in TEMPLATES))
    x = x.select("text_id", best.alias("b")).groupBy("text_id").agg(F.max("b").alias("b")).where(F.col("b.cosine") >= LEAST)
    return x.select("text_id", F.get(names, -F.col("b.k")).alias("licence"), F.col("b.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but text, and own_licence, cosine, licence, licence_from: one row for each row of (path, text, ...); licence_from is the path of the text that says so."""
    results = ("own_licence", "cosine", "licence", "licence_from")
    more = [c for c in files.columns if c.lower() not in ("path", "text", *results)]
    plain = [f"c{k}" for k in range(len(more))]  # whatever they are called, they don't meet our own names
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = files.select(F.col("path").cast("string").alias("path"), text.alias("text"), text_key(text).alias("text_id"), *(F.col(f"`{c}`").alias(p) for c, p in zip(more, plain)))
    scratch = Scratch(files.sparkSession)
    own = scratch.write(own_licences(rows))
    rows = rows.drop("text").withColumn("dir", directory(F.col("path")))
    rows = lookup(rows, own, "text_id")
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    is_file = F.regexp_replace(name, r"\.[a-z]+$", "").isin(*LICENCE_FILES)
    # one row a directory: the best licence file in it
    best = F.min_by(F.struct("path", "licence"), F.struct(-F.col("cosine"), F.col("path")))
    by_dir = rows.where(F.col("path").isNotNull() & F.col("licence").isNotNull() & is_file).groupBy(F.col("dir").alias("above")).agg(best.alias("file"))
    dirs = rows.where(F.col("path").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"))
    up = up.withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = scratch.write(lookup(up, by_dir, "above", "inner").groupBy("dir").agg(F.max_by("file", "depth").alias("file")))
    out = lookup(rows, nearest, "dir")
    out = out.select(
        *plain, "path", F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "file.licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("file.path")).alias("licence_from"),
    )
    return scratch.last(out).toDF(*more, "path", *results)
