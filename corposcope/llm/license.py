"""License scan: MinHash bands over text windows retrieve templates, shingles verify.

All steps are DataFrame expressions.  Words are runs of letters and digits in lower
case, shingles five words.  Templates are sorted into classes by their number of
distinct shingles, ``c`` being the next power of two; the windows of a class hold
``2c`` shingles and start every ``c``, so a copy of the template lies whole in one.

A window that holds 0.8 of a template of its class has a Jaccard similarity of at
least 0.18 with it (0.8 * c/2 common shingles of at most 2c + 0.2 * c/2).  With 64
bands of one row the chance that none collides is below (1 - 0.18) ** 64 = 4e-6.
A window without any shingle of a template collides with none in any band, so only
windows with such a shingle get a signature, and only texts with one of a few words
that every template shingle has at least one of are cut into shingles at all; both
leave the result as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import unnest
from ..functions.text import pin

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
# The templates are a stated list; more shingles than this are refused.
MOST_SHINGLES = 20_000

# Common license statements.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _spell(own: Column, at: Column) -> Column:
    """The shingle that starts at a 0-based word."""
    return F.concat_ws(" ", *(own[at + k] for k in range(SHINGLE)))


def _starts(own: Column) -> Column:
    """0-based starts of the shingles of a word array."""
    n = F.size(own) - (SHINGLE - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _shingles(own: Column, starts: Column) -> Column:
    return F.array_distinct(F.transform(starts, lambda i: _spell(own, i)))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id int, license string, template string")


def prepare(templates: DataFrame) -> DataFrame:
    """(template_id, license, shingles, n, c) of the templates of five words or more."""
    own = templates.where("template_id is not null").dropDuplicates(["template_id"])
    cut = own.select("template_id", "license", pin(words(F.col("template")), lambda w: _shingles(w, _starts(w))).alias("shingles"))
    cut = cut.withColumn("n", F.size("shingles")).where("n > 0")
    return cut.withColumn("c", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int"))


def _signature(shingles: Column) -> Column:
    """Array of (band, value): the least hash of the shingles under each of ``BANDS`` hashes."""
    return pin(
        F.transform(shingles, lambda s: F.xxhash64(s)),
        lambda hashed: F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, b))).alias("value")),
        ),
    )


def _anchors(shingles: list[list[str]]) -> list[str]:
    """Words, chosen greedily, of which every shingle has at least one."""
    left, chosen = [set(s.split(" ")) for s in shingles], []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
        # Longer words are rarer in texts.
        best = max(counts, key=lambda w: (counts[w] * (len(w) - 1), w))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template_id, license, containment, first_word, windows): one row per text and
    template found in it - the largest share of the template's shingles in one window,
    the first word of the first window that holds 0.8 or more, and how many do.

    Whole texts are read.  Null and short texts match nothing.  Rows with one key are
    one document; rows with a null key are one too.  Templates under five words, or
    without an id, are left out.  Without texts or templates there are no rows.
    """
    spark = docs.sparkSession
    known = prepare(default_templates(spark) if templates is None else templates)
    rows = known.select("shingles", "c").limit(MOST_SHINGLES + 1).collect()
    spelled = sorted({s for r in rows for s in r["shingles"]})
    if len(rows) > MOST_SHINGLES or len(spelled) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles")
    kind = docs.schema[key].dataType.simpleString()
    if not spelled:
        return spark.createDataFrame([], f"`{key}` {kind}, template_id int, license string, containment double, first_word int, windows bigint")

    anchors = F.array(*map(F.lit, _anchors(spelled)))
    classes = sorted({r["c"] for r in rows})

    def windows(w: Column, hits: Column, c: int) -> Column:
        """The windows of a class that have a shingle of a template."""
        at = F.transform(hits, lambda h: (h - h % c).cast("int"))
        starts = F.array_distinct(F.filter(F.concat(at, F.transform(at, lambda a: a - c)), lambda a: a >= 0))
        end = lambda a: F.least(a + (2 * c - 1), F.size(w) - SHINGLE)
        return F.transform(starts, lambda a: F.struct(F.lit(c).alias("c"), a.alias("start"), _shingles(w, F.sequence(a, end(a))).alias("held")))

    def cut(w: Column) -> Column:
        hits = F.filter(_starts(w), lambda i: _spell(w, i).isin(spelled))
        found = pin(hits, lambda h: F.flatten(F.array(*(windows(w, h, c) for c in classes))))
        return F.when(F.arrays_overlap(w, anchors), found)

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    held = unnest(source, pin(words(F.col("text")), cut), "x", "key").select("key", "x.c", "x.start", "x.held")
    probes = unnest(held, _signature(F.col("held")), "s", "key", "c", "start", "held").select("key", "c", "start", "held", "s.band", "s.value")
    index = unnest(known, _signature(F.col("shingles")), "s", "template_id", "license", "c", "n", "shingles")
    index = index.select("template_id", "license", "c", "n", "shingles", "s.band", "s.value")
    # At most MOST_SHINGLES templates, each with BANDS rows.
    met = probes.join(F.broadcast(index), ["c", "band", "value"])
    share = F.size(F.array_intersect("held", "shingles")) / F.col("n")
    checked = met.select("key", "template_id", "license", "start", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    found = checked.groupBy("key", "template_id", "license").agg(
        F.max("share").alias("containment"), F.min("start").alias("first_word"), F.count_distinct("start").alias("windows")
    )
    return found.withColumnRenamed("key", key)
