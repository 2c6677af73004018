"""Operator 3: license texts in documents, retrieved by MinHash bands of overlapping windows and verified by shingle containment. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and bands of one minwise token each. A window that holds 0.8 of a template's shingles has a
#: resemblance of at least 2/3 to it, so that no band collides once in 3 ** 16 = 43 million times.
WORDS, BANDS = 5, 16
#: Windows of a template's length begin at every sixteenth of it.
STRIDES = 16
#: The templates' tokens are literals of the plan, so many templates at a time; more are looked for in turn.
TEMPLATES_AT_ONCE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: Column) -> Column:
    """The runs of a-z and 0-9, after A-Z are lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """A hash for each shingle of so many words, in order; none for fewer words."""
    n = F.size(words) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generated column is not put in the place of each use."""
    return df.withColumn(name, F.explode(F.array(value)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(name, text) for name, text in templates.items()]
    return spark.createDataFrame(rows, "license string, template string").repartition(1)


def license_matches(documents: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document and template with a window that contains at least the share least of the template's distinct shingles.

    id, license, start (of the best window: its first word, from 0), n_words (of a window), containment; of windows as
    good the first. Words are runs of a-z and 0-9 without regard to case; a window has as many words as the template
    and begins at multiples of a sixteenth of that, and at the document's end it is shorter. Templates of fewer than
    WORDS words match nothing. Null and empty texts match nothing; rows with the same or no id are matched row by row,
    so an id that stands twice has the rows of both. Further columns are not read; an empty table gives an empty result.

    Each shingle is hashed once. A window collides with a template in a band if the least of its shingles by that band's
    order is the template's. That shingle is then in the document, so documents without any template's minwise shingle
    are done at once, and elsewhere only windows around such shingles are looked at. What is collected and broadcast:
    the minwise shingles of TEMPLATES_AT_ONCE templates; where there are more, the documents are read once for each such
    part of them.
    """
    if len(templates) > TEMPLATES_AT_ONCE:
        names = list(templates)
        parts = [{n: templates[n] for n in names[i : i + TEMPLATES_AT_ONCE]} for i in range(0, len(names), TEMPLATES_AT_ONCE)]
        return reduce(DataFrame.unionByName, [license_matches(documents, part, least, id_column, text_column) for part in parts])
    spark = documents.sparkSession
    order = lambda h, band: F.xxhash64(h, band)
    known = once(template_table(spark, templates), "words", words_of(F.col("template")))
    known = once(known, "own", F.array_distinct(shingles_of(F.col("words"), WORDS))).filter(F.size("own") > 0)
    bands = known.select("license", F.size("words").alias("n_words"), "own", F.explode(F.sequence(F.lit(1), F.lit(BANDS))).alias("band"))
    least_of = F.array_min(F.transform("own", lambda h: F.struct(order(h, F.col("band")).alias("at"), h.alias("h"))))
    tokens = bands.withColumn("token", least_of["h"]).select("license", "n_words", "own", "band", "token")
    wanted = sorted({r["token"] for r in tokens.select("token").collect()})

    split = once(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "words", words_of(F.col("text"))).select("id", "words")
    hashed = once(split, "hashes", shingles_of(F.col("words"), WORDS)).select("id", "hashes")
    listed = ", ".join(f"{t}L" for t in wanted) or "NULL"
    held = F.expr(f"exists(hashes, h -> h IN ({listed}))")
    places = F.expr(f"filter(transform(hashes, (h, i) -> struct(i AS p, h AS token)), x -> x.token IN ({listed}))")
    # the row number tells rows of one id apart
    near = hashed.filter(held).withColumn("row", F.monotonically_increasing_id()).select("id", "row", "hashes", F.explode(places).alias("x")).select("id", "row", "hashes", "x.p", "x.token")
    stride = F.greatest(F.floor(F.col("n_words") / STRIDES), F.lit(1)).cast("int")
    first = F.greatest(F.col("p") - F.col("n_words") + WORDS, F.lit(0))
    starts = F.sequence(F.ceil(first / stride).cast("int"), F.floor(F.col("p") / stride).cast("int"))
    met = near.join(F.broadcast(tokens), "token").filter(F.ceil(first / stride) <= F.floor(F.col("p") / stride)).withColumn("place", F.explode(starts)).withColumn("start", F.col("place") * stride)
    met = once(met, "window", F.slice("hashes", F.col("start") + 1, F.col("n_words") - WORDS + 1)).drop("hashes")
    collides = F.array_min(F.transform("window", lambda h: order(h, F.col("band")))) == order(F.col("token"), F.col("band"))
    share = F.size(F.array_intersect("window", "own")) / F.size("own")
    found = met.filter(collides).withColumn("containment", share).filter(F.col("containment") >= least)
    best = found.groupBy("id", "row", "license", "n_words").agg(F.max(F.struct("containment", (-F.col("start")).alias("before"))).alias("best"))
    return best.select(F.col("id").alias(id_column), "license", (-F.col("best.before")).cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("best.containment", 6).alias("containment"))
